"""The queries over the driver's tables, each with its DuckDB text where SQL can say the same."""
