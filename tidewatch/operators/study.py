"""User-study rollups (A2-A6, A13, E17, E18, E20) over a decision log
``(user_id, phase, alert_idx, user_decision, time_seconds, true_label ...)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import correct_flag
from ..functions.quantiles import quantiles_long, to_long


def with_correct(decisions: DataFrame) -> DataFrame:
    """correct = decision text matches the true label."""
    return decisions.withColumn("correct", correct_flag("user_decision", "true_label"))


def user_phase_rollup(decisions: DataFrame) -> DataFrame:
    """A2: per user and phase: accuracy, mean time, correct count, n."""
    return decisions.groupBy("user_id", "phase").agg(
        F.avg("correct").alias("accuracy"), F.avg("time_seconds").alias("mean_time"),
        F.sum("correct").cast("bigint").alias("n_correct"), F.count(F.lit(1)).alias("n"))


def phase_summary(rollup: DataFrame) -> DataFrame:
    """A3: per phase mean and sample std of the per-user means."""
    return rollup.groupBy("phase").agg(
        F.avg("accuracy").alias("accuracy_mean"), F.stddev_samp("accuracy").alias("accuracy_std"),
        F.avg("mean_time").alias("time_mean"), F.stddev_samp("mean_time").alias("time_std"),
        F.count(F.lit(1)).alias("users"))


def describe(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """A4: count, mean, std (sample), min, 25/50/75 % (interpolated, exact),
    max per group and column, in long form (by..., column, stat values)."""
    by = list(by)
    long = to_long(df, cols, by)
    basic = long.groupBy(*by, "c_name").agg(
        F.count(F.lit(1)).alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"))
    q = quantiles_long(long, [0.25, 0.5, 0.75], by)
    qw = (q.groupBy(*by, "c_name").pivot("q", [0.25, 0.5, 0.75]).agg(F.first("value"))
          .withColumnRenamed("0.25", "p25").withColumnRenamed("0.5", "p50").withColumnRenamed("0.75", "p75"))
    return basic.join(qw, by + ["c_name"]).withColumnRenamed("c_name", "column")


def question_summary(answers: DataFrame) -> DataFrame:
    """Mean, sample std and median per question (long-form answers)."""
    a = answers.select("question", F.col("answer").cast("double").alias("answer"))
    basic = a.groupBy("question").agg(F.avg("answer").alias("mean"), F.stddev_samp("answer").alias("std"),
                                      F.count(F.lit(1)).alias("n"))
    med = quantiles_long(a.select("question", F.lit("answer").alias("c_name"), F.col("answer").alias("v")),
                         [0.5], ["question"]).select("question", F.col("value").alias("median"))
    return basic.join(med, "question")


def distinct_users(decisions: DataFrame) -> DataFrame:
    """A6."""
    return decisions.agg(F.count_distinct("user_id").alias("users"))


def session_summary(decisions: DataFrame) -> DataFrame:
    """Per phase mean decision time and correct count."""
    return decisions.groupBy("phase").agg(F.avg("time_seconds").alias("mean_time"),
                                          F.sum("correct").cast("bigint").alias("n_correct"),
                                          F.count(F.lit(1)).alias("decisions"))
