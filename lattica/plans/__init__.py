"""Registered queries: each a Spark plan and, where SQL can express it, its DuckDB twin."""
