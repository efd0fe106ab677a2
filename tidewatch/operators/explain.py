"""Alert explanations.

Contributions are long-form rows ``(alert_id, feature, value, importance)``:
one row per alert and feature, so every per-alert step (split by sign, sort,
top-n, narrative) works on a group bounded by the number of features.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import (DEFAULT_FEATURE_TEXT, NARRATIVE_HEAD, direction, label_text, pushed_toward,
                                 value_band)


def linear_contributions(scaled: DataFrame, id_col: str, features: Sequence[str], weights: DataFrame) -> DataFrame:
    """contribution = scaled value x feature weight; ``weights`` is
    (feature, weight) with one row per feature (broadcast: bounded by the
    feature count)."""
    long = scaled.select(id_col, *features).unpivot([id_col], list(features), "feature", "value")
    return (long.join(F.broadcast(weights), "feature")
            .select(F.col(id_col).alias("alert_id"), "feature", "value",
                    (F.col("value") * F.col("weight")).alias("importance")))


def global_importance(contrib: DataFrame) -> DataFrame:
    """A10: mean |contribution| per feature."""
    return contrib.groupBy("feature").agg(F.avg(F.abs("importance")).alias("mean_abs_importance"))


def top_features(importance: DataFrame, k: int, col: str = "mean_abs_importance") -> DataFrame:
    """L3/L4: top-k by importance (ties by name)."""
    return importance.orderBy(F.desc(col), F.asc("feature")).limit(k)


def _per_alert(contrib: DataFrame) -> DataFrame:
    """``alert_id, contributions`` (all of an alert, ordered by feature). Rows
    are dealt once, and grouped where they lie, so nothing is sorted before."""
    return contrib.repartition("alert_id").groupBy("alert_id").agg(
        F.array_sort(F.collect_list(F.struct("feature", "value", "importance"))).alias("contributions"))


def _top(contributions: str, n_pos: int, n_neg: int) -> Column:
    """The shown contributions of an alert with their ``position``."""
    def side(keep, sign: int, n: int, shift: int) -> Column:
        keyed = F.transform(F.filter(contributions, lambda c: keep(c["importance"])), lambda c: F.struct(
            (sign * c["importance"]).alias("key"), c["feature"].alias("feature"), c["value"].alias("value"), c["importance"].alias("importance")))
        return F.transform(F.slice(F.array_sort(keyed), 1, n), lambda c, i: F.struct(
            (i + 1 + shift).alias("position"), c["feature"].alias("feature"), c["value"].alias("value"), c["importance"].alias("importance")))
    return F.concat(side(lambda x: x >= 0, -1, n_pos, 0), side(lambda x: x < 0, 1, n_neg, n_pos))


def split_top(contrib: DataFrame, n_pos: int = 5, n_neg: int = 3) -> DataFrame:
    """Per alert the ``n_pos`` largest non-negative contributions, then
    the ``n_neg`` most negative; ``position`` gives the display order."""
    return _per_alert(contrib).select("alert_id", F.inline(_top("contributions", n_pos, n_neg))).select(
        "alert_id", "feature", "value", "importance", "position")


def _shown(position: Column, feature: Column, value: Column, imp: Column, description: Column) -> list[Column]:
    """Columns of a shown contribution: rounded numbers and texts."""
    return [
        position.alias("position"), feature.alias("feature"),
        F.round(value, 3).alias("value"), F.round(imp, 4).alias("importance"),
        F.coalesce(description, F.lit(DEFAULT_FEATURE_TEXT)).alias("description"),
        direction(imp).alias("direction"),
        value_band(value).alias("value_summary"),
        F.format_string("%s (%s, importance: %.4f)", feature, value_band(value), F.abs(imp)).alias("plain_english"),
        F.format_string("- **%s** was %s (%.2f), which %s (importance: %.4f)", feature,
                        value_band(value, near_normal=False), value, pushed_toward(imp), F.abs(imp)).alias("summary_line")]


def explanation_rows(top: DataFrame, descriptions: DataFrame | None = None) -> DataFrame:
    """Per shown feature: rounded value/importance, description (J3
    lookup with default), direction, value band, plain-English line and the
    markdown summary line."""
    x = top
    if descriptions is not None:
        x = x.join(F.broadcast(descriptions), "feature", "left")
    else:
        x = x.withColumn("description", F.lit(None).cast("string"))
    return x.select("alert_id", *_shown(*(F.col(c) for c in ("position", "feature", "value", "importance", "description"))))


def explanation_documents(contrib: DataFrame, verdicts: DataFrame, descriptions: DataFrame | None = None,
                          n_pos: int = 5, n_neg: int = 3) -> DataFrame:
    """X4 whole: one nested row per alert: verdict texts, probability, a
    summary sentence (P16), the shown features with their texts in display
    order, their lines, and all features. ``verdicts`` has ``alert_id,
    true_text, predicted_text, correct, probability``. Groups are bounded by
    the number of features. Contributions and verdicts move once, by alert;
    texts are written when both are in place."""
    x = verdicts.join(_per_alert(contrib), "alert_id")
    none = F.array(F.lit(None).cast("string"))
    if descriptions is not None:
        known = descriptions.agg(F.collect_list(F.struct("feature", "description")).alias("_known"))
        x = x.crossJoin(F.broadcast(known))

    def texts(c: Column) -> Column:
        found = none
        if descriptions is not None:
            own = F.transform(F.filter("_known", lambda k: k["feature"] == c["feature"]), lambda k: k["description"])
            found = F.when(F.size(own) > 0, own).otherwise(none)
        return F.transform(found, lambda d: F.struct(*_shown(c["position"], c["feature"], c["value"], c["importance"], d)))

    x = x.withColumn("_top", _top("contributions", n_pos, n_neg)).filter(F.size("_top") > 0)
    x = x.withColumn("_shown", F.array_sort(F.flatten(F.transform("_top", texts))))
    cells = ["position", "feature", "value", "importance", "description", "direction", "value_summary", "plain_english"]
    every = F.array_sort(F.transform("contributions", lambda c: F.struct(
        c["feature"].alias("feature"), F.round(c["value"], 3).alias("value"), F.round(c["importance"], 4).alias("importance"))))
    sentence = F.format_string("Classified as **%s** with a confidence of %.2f%%, which is **%s** (true label: %s).", F.col("predicted_text"),
                               F.col("probability") * 100, F.when(F.col("correct"), "right").otherwise("wrong"), F.col("true_text"))
    return x.select(
        "alert_id", F.col("true_text").alias("true_label"), F.col("predicted_text").alias("predicted"), F.round("probability", 4).alias("probability"),
        "correct", sentence.alias("summary"), F.transform("_shown", lambda s: s["summary_line"]).alias("details"),
        F.transform("_shown", lambda s: F.struct(*[s[c].alias(c) for c in cells])).alias("features"), every.alias("all_features"))


def narratives(contrib: DataFrame, k: int = 3, alert_type=None) -> DataFrame:
    """X5/L6/P13: 'Alert triggered primarily by: f (12.3% contribution), ...'
    over the top-k features by weight (share of |contribution|)."""
    tot = F.sum(F.abs("importance")).over(Window.partitionBy("alert_id"))
    x = contrib.withColumn("weight", F.when(tot == 0, 0.0).otherwise(F.abs("importance") / tot))
    per = x.groupBy("alert_id").agg(F.collect_list(F.struct(
        (-F.col("weight")).alias("neg_w"), F.col("feature"), F.col("weight"))).alias("fs"))
    top = F.slice(F.array_sort("fs"), 1, k)
    parts = F.transform(top, lambda s: F.format_string("%s (%.1f%% contribution)", s["feature"], s["weight"] * 100))
    text = F.concat(F.lit(NARRATIVE_HEAD), F.array_join(parts, ", "), F.lit("."))
    if alert_type is not None:
        at = F.col(alert_type) if isinstance(alert_type, str) else alert_type
        text = F.concat(text, F.when(at.isNotNull(), F.concat(F.lit(" Classification: "), at, F.lit("."))).otherwise(""))
    return per.select("alert_id", text.alias("narrative"))


def proxy_explanations(id_col: str, scaled_features: DataFrame, importances: DataFrame, k: int = 10) -> DataFrame:
    """The global top-k importances repeated for every alert with that
    alert's scaled values, as ARRAY<STRUCT<feature, value, importance>>."""
    top = top_features(importances, k).select("feature", F.col("mean_abs_importance").alias("importance"))
    vals = scaled_features.join(F.broadcast(top), "feature")
    per = vals.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("importance")).alias("rank_key"), "feature", "value", "importance"))).alias("fs"))
    feats = F.transform("fs", lambda s: F.struct(s["feature"].alias("feature"), s["value"].alias("value"),
                                                 s["importance"].alias("importance")))
    return per.select(id_col, feats.alias("features"))


def verdict_text(df: DataFrame, true_label: str, predicted: str) -> DataFrame:
    """P9 on both labels plus the correctness flag."""
    return df.withColumn("true_text", label_text(true_label)).withColumn(
        "predicted_text", label_text(predicted)).withColumn("correct", F.col(true_label) == F.col(predicted))
