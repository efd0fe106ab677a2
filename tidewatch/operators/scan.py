"""Ordered per-key scans that stay balanced when one key is hot.

``sum(x) over (partition by key order by t)`` puts every row of a key in one
task. At scale one source address can hold a third of all packets, so the
running sum is computed in two phases instead (a segmented prefix sum):

1. local running sums within ``(key, bucket)`` where ``bucket`` is a coarse,
   order-compatible slice of the order key (an hour of event time by default);
2. per-bucket totals (a partial aggregate: map-side combined, tiny) turned into
   per-bucket offsets by a window over buckets only;
3. offset + local sum, joined on ``(key, bucket)``. The big side is already
   hash-partitioned on ``(key, bucket)`` by step 1, so only the small offsets
   table moves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def time_bucket(ts: str | Column, seconds: int) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(c) / (seconds * 1_000_000)).cast("bigint")


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str | Sequence[str],
                bucket: Column, out: str | Sequence[str]) -> DataFrame:
    """Add ``out`` = inclusive running sum of ``value`` per ``keys`` in
    ``order`` (several value/out columns share one pass). ``bucket`` must be
    non-decreasing along ``order`` within a key."""
    keys = list(keys)
    values = [value] if isinstance(value, str) else list(value)
    outs = [out] if isinstance(out, str) else list(out)
    b = "_seg_bucket"
    x = df.withColumn(b, bucket)
    part = keys + [b]
    w_local = (Window.partitionBy(*part).orderBy(*order)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = x.select("*", *[F.sum(v).over(w_local).alias(f"_seg_local{i}") for i, v in enumerate(values)])
    totals = x.groupBy(*part).agg(*[F.sum(v).alias(f"_seg_total{i}") for i, v in enumerate(values)])
    w_prev = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*part, *[F.coalesce(F.sum(f"_seg_total{i}").over(w_prev), F.lit(0))
                                     .alias(f"_seg_offset{i}") for i in range(len(values))])
    joined = local.join(offsets, part)
    for i, o in enumerate(outs):
        joined = joined.withColumn(o, F.col(f"_seg_offset{i}") + F.col(f"_seg_local{i}"))
    return joined.drop(b, *[f"_seg_local{i}" for i in range(len(values))],
                       *[f"_seg_offset{i}" for i in range(len(values))])


def last_value(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, bucket: Column, out: str) -> DataFrame:
    """Add ``out`` = the latest non-null ``value`` up to each row, per ``keys``
    in ``order`` (an as-of join of a table with itself). Inside a bucket it is
    a running last; a bucket that begins without one takes the last of the
    buckets before (one row per bucket). ``bucket`` must be non-decreasing
    along ``order`` within a key."""
    keys = list(keys)
    b, own, before = "_last_bucket", "_last_own", "_last_before"
    x = df.withColumn(b, bucket)
    part = [*keys, b]
    inside = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = x.where(F.col(value).isNotNull()).groupBy(*part).agg(F.max_by(value, F.struct(*order)).alias(own))
    every = x.select(*part).distinct().join(ends, part, "left")
    carried = every.select(*part, F.last(own, ignorenulls=True).over(
        Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)).alias(before))
    return (x.withColumn(own, F.last(value, ignorenulls=True).over(inside)).join(carried, part)
            .withColumn(out, F.coalesce(own, before)).drop(b, own, before))


def global_row_number(df: DataFrame, order: Sequence[str], out: str = "rn") -> DataFrame:
    """1-based row number in a global order without a single-partition window:
    a range-partitioned sort is written once (to the session's checkpoint
    folder, so the numbers stay what they are), numbered within its partitions
    by the engine, and shifted by the rows of the partitions before (one row
    per partition)."""
    checkpoint_dir(df.sparkSession)
    own = "_own_id"
    x = df.orderBy(*order).withColumn(own, F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright(own, 33)
    sizes = x.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = F.col(own).bitwiseAND(F.lit((1 << 33) - 1))
    return (x.withColumn("_part", part).join(shift, "_part")
            .withColumn(out, F.col("_shift") + inside + 1).drop("_part", "_shift", own))


#: Rows of one segment of :func:`halo_segments`.
SEGMENT_ROWS = 1 << 16


def halo_segments(df: DataFrame, order: Sequence[str], halo: int, segment_rows: int = SEGMENT_ROWS, after: int = 0) -> DataFrame:
    """Rows dealt to segments of ``segment_rows`` in a global order, each with
    copies of the ``halo`` rows before it and the ``after`` rows behind it: adds ``_seg``, ``_pos`` (the row's
    number in the order) and ``_halo`` (TRUE for copies).

    A window of at most ``halo`` preceding and ``after`` following rows can then be taken per segment,
    whatever entity the rows belong to: its rows that aren't copies see all
    they need, no task needs more than a segment and its halo, and an entity
    with most of all rows is spread like any other."""
    if not (0 <= halo < segment_rows and 0 <= after < segment_rows):
        raise ValueError("the halo lies in one segment")
    x = global_row_number(df, order, "_pos").withColumn("_pos", F.col("_pos") - 1)
    own = F.floor(F.col("_pos") / segment_rows).cast("bigint")
    tail = F.col("_pos") % segment_rows >= segment_rows - halo
    both = F.array(F.struct(own.alias("_seg"), F.lit(False).alias("_halo")), F.struct((own + 1).alias("_seg"), F.lit(True).alias("_halo")))
    place = F.when(tail, both).otherwise(F.slice(both, 1, 1))
    if after:
        back = F.array(F.struct((own - 1).alias("_seg"), F.lit(True).alias("_halo")))
        place = F.when(F.col("_pos") % segment_rows < after, F.concat(place, back)).otherwise(place)
    place = F.explode(place)
    return x.withColumn("_place", place).select(*x.columns, "_place._seg", "_place._halo")
