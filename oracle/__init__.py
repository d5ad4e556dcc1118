"""Independent SQL for the registered queries, run by DuckDB on the same tables."""
