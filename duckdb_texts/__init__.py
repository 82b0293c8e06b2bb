"""DuckDB texts that every registered query is checked against."""
