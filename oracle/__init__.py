"""DuckDB twins of the registered queries, written independently of the Spark code."""
