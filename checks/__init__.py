"""Every operator as a registered query over the driver tables, with a DuckDB oracle where SQL can say it."""
