"""Exact, interpolated quantiles without buffering a column in one task.

Spark's exact ``percentile`` keeps a value->count map per group and merges it
in a single task: unbounded for continuous columns. Here:

1. one aggregate pass gives, per (group, column), the count ``n`` and a
   ``percentile_approx`` bracket ``[L, H]`` around the wanted rank. The sketch
   has a guaranteed rank error ``n/accuracy``; the bracket uses three times
   that (>= 2 ranks once n > accuracy). A group of ``n <= 2*accuracy`` rows is
   smaller than a bracket is meant to be, so its bracket is its whole range:
   the ranks found are the same. A rank outside its bracket raises.
2. a second pass counts values below ``L`` and groups the values inside the
   bracket by value (a few times ``n/accuracy`` rows per group);
3. a window over those in-bracket distinct values finds the values at the two
   ranks around ``q*(n-1)`` and interpolates linearly (same definition as
   pandas, numpy and DuckDB ``quantile_cont``).

Data are unpivoted to long form ``(by..., c_name, v)`` once, so any number of
columns costs the same two passes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir


#: Rows up to which a table of one row per group is sent to all tasks. Rows
#: dealt by so few keys would lie in as few tasks.
FEW = 10_000


def few(groups: DataFrame) -> DataFrame:
    """``groups`` written once, for a broadcast if they are few."""
    checkpoint_dir(groups.sparkSession)
    groups = groups.checkpoint()
    return F.broadcast(groups) if groups.count() <= FEW else groups


def to_long(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., c_name, v DOUBLE) with nulls and NaN dropped."""
    x = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols])
    long = x.unpivot(list(by), list(cols), "c_name", "v") if by else x.unpivot([], list(cols), "c_name", "v")
    return long.filter(F.col("v").isNotNull() & ~F.isnan("v"))


def quantiles_long(long: DataFrame, qs: Sequence[float], by: Sequence[str] = (),
                   accuracy: int = 10_000) -> DataFrame:
    """Exact interpolated quantiles of long-form data: returns
    (by..., c_name, q, value)."""
    keys = list(by) + ["c_name"]
    eps = 1.0 / accuracy
    lo_q = [max(q - 3 * eps, 0.0) for q in qs]
    hi_q = [min(q + 3 * eps, 1.0) for q in qs]
    small = 2 * accuracy
    stats = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx("v", lo_q + hi_q, accuracy).alias("_br"))
    nq = len(qs)
    brackets = stats.select(
        *keys, "n",
        F.explode(F.arrays_zip(
            F.array(*[F.lit(float(q)) for q in qs]).alias("q"),
            F.slice("_br", 1, nq).alias("lo"),
            F.slice("_br", nq + 1, nq).alias("hi"))).alias("b"))
    brackets = brackets.select(
        *keys, "n", F.col("b.q").alias("q"),
        F.when(F.col("n") <= small, F.lit(float("-inf"))).otherwise(F.col("b.lo")).alias("L"),
        F.when(F.col("n") <= small, F.lit(float("inf"))).otherwise(F.col("b.hi")).alias("H"))
    brackets = few(brackets) if by else F.broadcast(brackets)
    xb = long.join(brackets, keys)
    below = (xb.filter(F.col("v") < F.col("L")).groupBy(*keys, "q")
             .agg(F.count(F.lit(1)).alias("below")))
    inside = (xb.filter((F.col("v") >= F.col("L")) & (F.col("v") <= F.col("H")))
              .groupBy(*keys, "q", "v").agg(F.count(F.lit(1)).alias("cnt")))
    meta = (brackets.join(below, keys + ["q"], "left")
            .select(*keys, "q", "n", F.coalesce("below", F.lit(0)).alias("below")))
    w = (Window.partitionBy(*keys, "q").orderBy("v")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    pos = F.col("q") * (F.col("n") - 1)
    ranked = (inside.join(meta, keys + ["q"])
              .withColumn("_cum", F.sum("cnt").over(w))
              .withColumn("_first", F.col("below") + F.col("_cum") - F.col("cnt"))
              .withColumn("_last", F.col("below") + F.col("_cum") - 1)
              .withColumn("_rlo", F.floor(pos))
              .withColumn("_rhi", F.ceil(pos))
              .withColumn("_frac", pos - F.floor(pos)))
    hit = lambda r: (F.col("_first") <= F.col(r)) & (F.col(r) <= F.col("_last"))
    picked = ranked.groupBy(*keys, "q").agg(
        F.max(F.when(hit("_rlo"), F.col("v"))).alias("vlo"),
        F.max(F.when(hit("_rhi"), F.col("v"))).alias("vhi"),
        F.first("_frac").alias("frac"))
    missed = F.raise_error(F.lit("a quantile's rank lies outside its bracket")).cast("double")
    found = lambda c: F.coalesce(F.col(c), missed)
    return picked.select(*keys, "q", (found("vlo") + F.col("frac") * (found("vhi") - found("vlo"))).alias("value"))


def quantiles(df: DataFrame, cols: Sequence[str], qs: Sequence[float], by: Sequence[str] = (),
              accuracy: int = 10_000) -> DataFrame:
    return quantiles_long(to_long(df, cols, by), qs, by, accuracy)


def medians_row(df: DataFrame, cols: Sequence[str], accuracy: int = 10_000) -> DataFrame:
    """One row, one column per input column: its exact median (NULL when the
    column has no values)."""
    long = quantiles(df, cols, [0.5], accuracy=accuracy)
    wide = long.groupBy().pivot("c_name", list(cols)).agg(F.first("value"))
    return wide.select(*[F.col(c).cast("double").alias(c) if c in wide.columns
                         else F.lit(None).cast("double").alias(c) for c in cols])
