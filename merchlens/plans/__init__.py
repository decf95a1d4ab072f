"""Registered queries over the test tables, each next to its DuckDB counterpart."""
