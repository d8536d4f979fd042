"""DuckDB statements that recompute every job independently, for the correctness gate."""
