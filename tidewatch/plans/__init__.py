"""Registered queries (name -> (spark, sf_dir) -> DataFrame) and their
independent DuckDB oracle SQL."""

from .registry import oracle_sql, queries  # noqa: F401
