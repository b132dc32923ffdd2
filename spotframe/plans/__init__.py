"""Queries over the tables, each with the SQL that DuckDB answers alike where SQL can."""
