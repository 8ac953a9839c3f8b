"""Test views over the driver tables, and the DuckDB statement of every query."""
