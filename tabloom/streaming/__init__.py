"""The stateless cleaning steps on streaming DataFrames."""
