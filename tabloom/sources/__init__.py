"""Reading and writing: delimited files, rules, tables and run artifacts."""
