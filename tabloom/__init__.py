"""Synthetic tabular data on Spark: clean, align, synthesise and judge tables as DataFrame jobs."""
