"""Analyst feedback buffers and retraining cycles.

Feedback rows arrive in a global order and are processed in batches; after
each batch, if the two buffers hold at least ``interval`` rows together, a
retraining cycle closes and the buffers are cleared. Buffers keep the newest
``max_buffer`` rows per verdict. Verdicts other than confirmed/dismissed
are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scan import global_row_number

CONFIRMED, DISMISSED = "confirmed_tp", "dismissed_fp"


#: Batches of one segment of the cycle scan.
SEGMENT = 4096


def _advance(states: np.ndarray, counts: np.ndarray, interval: int) -> tuple[np.ndarray, np.ndarray]:
    """Buffered counts and closed cycles after each state has taken all of
    ``counts`` in turn."""
    closed = np.zeros(len(states), np.int64)
    for n in counts:
        states = states + n
        full = states >= interval
        closed += full
        states = np.where(full, 0, states)
    return states, closed


def assign_cycles(feedback: DataFrame, order: list[str], batch_size: int = 50, interval: int = 100,
                  max_buffer: int = 500) -> DataFrame:
    """Adds ``rn``, ``batch`` and ``cycle`` (NULL for rows after the last
    closed cycle: a trailing incomplete cycle triggers no retraining).

    Whether a batch closes a cycle depends on the number of buffered rows, 0 to
    ``interval`` - 1, so a segment of batches is a map from that number to the
    next segment's and a number of cycles. Segments are summarised in parallel
    for every start, their maps are composed (one small row per ``SEGMENT``
    batches), and each segment is replayed from its own start in parallel.
    That needs buffers that can't overflow before a cycle closes."""
    if max_buffer < interval + batch_size:
        raise ValueError("buffers must hold an interval and a batch")
    x = global_row_number(feedback, order, "rn").withColumn("batch", F.floor((F.col("rn") - 1) / batch_size))
    per_batch = x.groupBy("batch").agg(F.count(F.when(F.col("verdict").isin(CONFIRMED, DISMISSED), 1)).alias("n")) \
                 .withColumn("segment", F.floor(F.col("batch") / SEGMENT))

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        end, closed = _advance(np.arange(interval), pdf.sort_values("batch")["n"].to_numpy(), interval)
        return pd.DataFrame({"segment": [int(pdf["segment"].iloc[0])], "ends": [end.tolist()], "closes": [closed.tolist()], "task": [0]})

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        state, cycle, out = 0, 0, []
        for row in pdf.sort_values("segment").itertuples(index=False):
            out.append((row.segment, state, cycle))
            cycle += int(row.closes[state])
            state = int(row.ends[state])
        return pd.DataFrame(out, columns=["segment", "start", "first_cycle"])

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("batch")
        state, cycle, out = int(pdf["start"].iloc[0]), int(pdf["first_cycle"].iloc[0]), []
        for batch, n in zip(pdf["batch"].tolist(), pdf["n"].tolist()):
            state += n
            out.append((batch, cycle, state >= interval))
            if state >= interval:
                state, cycle = 0, cycle + 1
        return pd.DataFrame(out, columns=["batch", "cycle", "closes"])

    maps = per_batch.groupBy("segment").applyInPandas(summary, "segment bigint, ends array<bigint>, closes array<bigint>, task int")
    starts = maps.groupBy("task").applyInPandas(compose, "segment bigint, start bigint, first_cycle bigint")
    closed = per_batch.join(starts, "segment").groupBy("segment").applyInPandas(replay, "batch bigint, cycle bigint, closes boolean")
    last_closed = closed.filter("closes").agg(F.max("cycle").alias("_last"))
    return (x.join(closed, "batch").crossJoin(F.broadcast(last_closed))
            .withColumn("cycle", F.when(F.col("cycle") <= F.col("_last"), F.col("cycle")))
            .drop("closes", "_last"))


def retraining_set(cycles: DataFrame, max_buffer: int = 500, label_rule: str = "verdict") -> DataFrame:
    """U4: rows of each closed cycle, newest ``max_buffer`` per verdict,
    labelled 1 (confirmed) / 0 (dismissed), or by the true label when
    ``label_rule='truth'``."""
    x = cycles.filter(F.col("cycle").isNotNull() & F.col("verdict").isin(CONFIRMED, DISMISSED))
    w = Window.partitionBy("cycle", "verdict").orderBy(F.desc("rn"))
    x = x.withColumn("_age", F.row_number().over(w)).filter(F.col("_age") <= max_buffer).drop("_age")
    label = (F.when(F.col("verdict") == CONFIRMED, 1).otherwise(0) if label_rule == "verdict"
             else F.col("y_true"))
    return x.withColumn("label", label)


def feedback_stats(cycles: DataFrame, max_buffer: int = 500) -> DataFrame:
    """Buffered rows per verdict after the last cycle and cycle count."""
    rel = F.col("verdict")
    return cycles.agg(
        F.least(F.count(F.when(F.col("cycle").isNull() & (rel == CONFIRMED), 1)), F.lit(max_buffer))
        .alias("tp_buffer_size"),
        F.least(F.count(F.when(F.col("cycle").isNull() & (rel == DISMISSED), 1)), F.lit(max_buffer))
        .alias("fp_buffer_size"),
        F.coalesce(F.max("cycle") + 1, F.lit(0)).alias("retraining_cycles"))
