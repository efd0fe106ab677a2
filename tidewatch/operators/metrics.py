"""Classification metrics over a predictions table.

A predictions table has one row per scored item: ``y_true`` (0/1),
``y_pred`` (0/1) and optionally ``y_score`` plus grouping columns (model,
retraining cycle ...). Every metric is a grouped aggregate; the curve
metrics first reduce rows to distinct scores and then take running sums
with the segmented scan, so no step sorts all rows in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .scan import running_sum


def _div(a, b):
    """a / b, 0 when b is 0 (zero_division=0)."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def confusion(preds: DataFrame, by: Sequence[str] = (), y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    t, p = F.col(y_true), F.col(y_pred)
    return preds.groupBy(*by).agg(
        F.count(F.when((t == 0) & (p == 0), 1)).alias("tn"),
        F.count(F.when((t == 0) & (p == 1), 1)).alias("fp"),
        F.count(F.when((t == 1) & (p == 0), 1)).alias("fn"),
        F.count(F.when((t == 1) & (p == 1), 1)).alias("tp"))


def metrics_from_confusion(cm: DataFrame) -> DataFrame:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    precision = _div(tp, tp + fp)
    recall = _div(tp, tp + fn)
    return cm.select(
        "*",
        _div(tp + tn, tn + fp + fn + tp).alias("accuracy"),
        precision.alias("precision"), recall.alias("recall"),
        _div(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _div(fp, fp + tn).alias("fpr"),
        _div(fn, fn + tp).alias("fnr"))


def binary_metrics(preds: DataFrame, by: Sequence[str] = (), y_true: str = "y_true",
                   y_pred: str = "y_pred") -> DataFrame:
    return metrics_from_confusion(confusion(preds, by, y_true, y_pred))


def masked_metrics(preds: DataFrame, mask, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Precision, recall and F1 on the masked rows; zeros if the mask is empty."""
    m = binary_metrics(preds.filter(mask), (), y_true, y_pred)
    return m.select(F.col("precision").alias("mitm_precision"), F.col("recall").alias("mitm_recall"),
                    F.col("f1").alias("mitm_f1"))


def score_counts(preds: DataFrame, by: Sequence[str] = (), y_true: str = "y_true",
                 y_score: str = "y_score") -> DataFrame:
    """(by..., score, pos, neg): the only input the curve metrics need. The
    curve plans read it several times (bucket cuts, running sums, totals), so
    it is checkpointed once: the large predictions table is scanned once."""
    sc = preds.groupBy(*by, F.col(y_score).cast("double").alias("score")).agg(
        F.count(F.when(F.col(y_true) == 1, 1)).alias("pos"),
        F.count(F.when(F.col(y_true) != 1, 1)).alias("neg"))
    checkpoint_dir(preds.sparkSession)
    return sc.checkpoint()


def _with_cumulative(sc: DataFrame, by: Sequence[str], descending: bool, buckets: int) -> DataFrame:
    """Running pos/neg sums over distinct scores (inclusive). Buckets come from
    approximate score quantiles per group, so hot score ranges are split."""
    by = list(by)
    key = F.col("score") * (-1.0 if descending else 1.0)
    x = sc.withColumn("_k", key)
    qs = [i / buckets for i in range(1, buckets)]
    cuts = x.groupBy(*by).agg(F.percentile_approx("_k", qs, 10_000).alias("_cuts")) if by else \
        x.agg(F.percentile_approx("_k", qs, 10_000).alias("_cuts"))
    x = x.join(cuts, by) if by else x.crossJoin(F.broadcast(cuts))
    bucket = F.size(F.filter("_cuts", lambda c: c < F.col("_k")))
    keys = by if by else []
    if not keys:
        x = x.withColumn("_all", F.lit(0))
        keys = ["_all"]
    x = running_sum(x, keys, ["_k"], ["pos", "neg"], bucket, ["cum_pos", "cum_neg"])
    return x.drop("_cuts", "_all")


def auc_exact(preds: DataFrame, by: Sequence[str] = (), y_true: str = "y_true", y_score: str = "y_score",
              buckets: int = 64) -> DataFrame:
    """Mann-Whitney ROC-AUC with average ranks for ties:
    sum over scores of pos * (negatives below + neg/2) / (P * N); NULL when a
    class is absent. Counts are multiplied as doubles: their product leaves the
    range of a bigint at some billions of rows."""
    sc = score_counts(preds, by, y_true, y_score)
    c = _with_cumulative(sc, by, False, buckets)
    below = F.col("cum_neg") - F.col("neg")
    return c.groupBy(*by).agg(F.try_divide(
        F.sum(F.col("pos").cast("double") * (below + 0.5 * F.col("neg"))),
        F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))


def roc_points(preds: DataFrame, by: Sequence[str] = (), y_true: str = "y_true", y_score: str = "y_score",
               buckets: int = 64) -> DataFrame:
    """One (fpr, tpr) point per distinct score, thresholds descending; the
    (0, 0) origin is implicit in :func:`roc_auc_trapezoid`."""
    sc = score_counts(preds, by, y_true, y_score)
    c = _with_cumulative(sc, by, True, buckets)
    tot = sc.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    c = c.join(tot, list(by)) if by else c.crossJoin(F.broadcast(tot))
    return c.select(*by, "score", _div(F.col("cum_neg"), F.col("N")).alias("fpr"),
                    _div(F.col("cum_pos"), F.col("P")).alias("tpr"),
                    F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"), "P", "N", "pos", "neg")


def roc_auc_trapezoid(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Trapezoid area under the points (from the origin); NULL when a class is
    absent. A point and the one before it differ by the point's own counts, so
    the strip is neg * (2 * tp - pos) / (2 P N): no lag over the points."""
    strip = F.col("neg").cast("double") * (2.0 * F.col("tp") - F.col("pos"))
    return points.groupBy(*by).agg(F.try_divide(F.sum(strip), 2.0 * F.max("P") * F.max("N")).alias("auc_trapezoid"))


def average_precision(preds: DataFrame, by: Sequence[str] = (), y_true: str = "y_true",
                      y_score: str = "y_score", buckets: int = 64) -> DataFrame:
    """AP = sum_n (R_n - R_{n-1}) * P_n over descending thresholds, R_0 = 0.
    Since R_n - R_{n-1} = pos_n / P, no lag is needed. 0 without positives."""
    sc = score_counts(preds, by, y_true, y_score)
    c = _with_cumulative(sc, by, True, buckets)
    prec = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    return c.groupBy(*by).agg(F.coalesce(F.try_divide(F.sum(F.col("pos") * prec), F.sum("pos").cast("double")), F.lit(0.0))
                              .alias("average_precision"))


def long_form(models: dict[str, DataFrame]) -> DataFrame:
    """Stack several predictions tables tagged with ``model``."""
    frames = [df.withColumn("model", F.lit(name)) for name, df in models.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def model_comparison(preds_long: DataFrame, buckets: int = 64) -> DataFrame:
    """Rows = models, columns = metrics (incl. exact AUC)."""
    m = binary_metrics(preds_long, ["model"])
    a = auc_exact(preds_long, ["model"], buckets=buckets)
    return m.join(a, "model")
