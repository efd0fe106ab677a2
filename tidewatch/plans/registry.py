"""Query registry used by ``__spark_entry__`` and ``bench.py``."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, QueryFn] = {}
_ORACLE: dict[str, str] = {}
_MODULES = ("packet_queries", "prep_queries", "eval_queries", "study_queries",
            "response_queries", "explain_queries", "model_queries", "stream_queries", "source_queries")


def register(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its DuckDB oracle (omit when the operator
    is not SQL-expressible)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLE[name] = sql
        return fn
    return deco


def oracle(name: str) -> str:
    """SQL of a query registered before, for another way to the same rows."""
    return _ORACLE[name]


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"{__package__}.{m}")


def queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)
