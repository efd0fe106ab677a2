"""Helpers shared by the query modules."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def fmt_ts(c) -> Column:
    """Timestamps leave queries as text with microseconds (same in DuckDB)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def rnd(c, places: int) -> Column:
    """round(x * 10^p) / 10^p, half away from zero: the same arithmetic as
    DuckDB's ROUND(DOUBLE, p), so exact decimal ties (common for means of
    2-decimal values over power-of-two counts) resolve identically."""
    c = F.col(c) if isinstance(c, str) else c
    scale = float(10 ** places)
    return F.round(c.cast("double") * scale, 0) / scale


def r6(c, alias: str | None = None) -> Column:
    out = rnd(c, 6)
    return out.alias(alias) if alias else out
