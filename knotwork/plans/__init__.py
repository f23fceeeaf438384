"""Logical plans that Spark and DuckDB share."""
