"""Explanations, dashboard bands and metric series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import band
from ..functions.quantiles import quantiles_long
from ..operators import explain as ex
from ..operators import metrics as mt
from ..operators import packets as pk
from ..operators import prep
from ..sources.views import flows, packets, predictions
from .common import r6, rnd
from .packet_queries import CAPTURE_ALERTS_SQL, W
from .prep_queries import NUM
from .registry import register
from .sql_views import FLOWS_CTE, PREDICTIONS_CTE

# Own short descriptions for the flow features (P14 dictionary).
FEATURE_TEXT = {
    "quantity": "Packets carried by the flow.",
    "price": "Bytes carried by the flow.",
    "discount": "Share of retransmitted segments.",
}

# DuckDB side: z-scores, MI weights (10 equal-width bins) and contributions.
CONTRIB_SQL = f"""WITH {FLOWS_CTE},
long AS (UNPIVOT (SELECT row_id, label, quantity, price, discount, tax FROM flows)
         ON quantity, price, discount, tax INTO NAME feature VALUE v),
rng AS (SELECT feature, min(v) AS lo, max(v) AS hi, avg(v) AS mu, stddev_pop(v) AS sd FROM long GROUP BY feature),
b AS (SELECT feature, label, CASE WHEN hi = lo THEN 0 ELSE least(floor((v - lo) / (hi - lo) * 10), 9) END AS bin
      FROM long JOIN rng USING (feature)),
j AS (SELECT feature, bin, label, count(*) AS nxy FROM b GROUP BY ALL),
m AS (SELECT *, sum(nxy) OVER (PARTITION BY feature) AS n, sum(nxy) OVER (PARTITION BY feature, bin) AS nx,
             sum(nxy) OVER (PARTITION BY feature, label) AS ny FROM j),
mi AS (SELECT feature, sum(nxy / n * ln(nxy * n / (nx * ny))) AS weight FROM m GROUP BY feature),
alerts AS (SELECT row_id FROM flows WHERE quantity / 50.0 > 0.5),
contrib AS (SELECT l.row_id AS alert_id, l.feature, (l.v - mu) / CASE WHEN sd = 0 THEN 1 ELSE sd END AS value,
                   (l.v - mu) / CASE WHEN sd = 0 THEN 1 ELSE sd END * weight AS importance
            FROM long l JOIN rng USING (feature) JOIN mi USING (feature) WHERE l.row_id IN (SELECT row_id FROM alerts))"""


def _contributions(spark, sf_dir):
    f = flows(spark, sf_dir).select("row_id", "label", *NUM, (F.col("quantity") / 50.0 > 0.5).alias("is_alert"))
    weights = prep.binned_mutual_info(f, NUM, "label", bins=10).select("feature", F.col("mi").alias("weight"))
    scaled, _ = prep.normalize(f, NUM, "zscore")
    alerts = scaled.filter("is_alert")
    return ex.linear_contributions(alerts, "row_id", NUM, weights)


@register("global_importance", sql=f"""{CONTRIB_SQL}
SELECT feature, ROUND(avg(abs(importance)), 6) AS mean_abs_importance FROM contrib GROUP BY feature""")
def global_importance(spark, sf_dir):
    """A10: mean |contribution| per feature over all alerts."""
    g = ex.global_importance(_contributions(spark, sf_dir))
    return g.select("feature", r6("mean_abs_importance", "mean_abs_importance"))


@register("top_importance", sql=f"""{CONTRIB_SQL}
SELECT feature, ROUND(avg(abs(importance)), 6) AS mean_abs_importance FROM contrib GROUP BY feature
ORDER BY avg(abs(importance)) DESC, feature LIMIT 3""")
def top_importance(spark, sf_dir):
    """L3/L4: top-k features by mean |contribution| (k is the feature)."""
    g = ex.top_features(ex.global_importance(_contributions(spark, sf_dir)), 3)
    return g.select("feature", r6("mean_abs_importance", "mean_abs_importance"))


def _bands(col: str, near: bool) -> str:
    rest = (f"CASE WHEN {col} < -0.5 THEN 'unusually low' WHEN {col} < -0.2 THEN 'lower than normal' "
            f"WHEN {col} > 0.5 THEN 'unusually high' WHEN {col} > 0.2 THEN 'higher than normal' "
            f"ELSE 'within normal range' END")
    if near:
        return f"CASE WHEN abs({col}) < 0.1 THEN 'was near-normal' ELSE 'was ' || {rest} END"
    return rest


@register("alert_explanations", sql=f"""{CONTRIB_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY alert_id, importance >= 0
              ORDER BY CASE WHEN importance >= 0 THEN -importance ELSE importance END, feature) AS rr FROM contrib),
t AS (SELECT *, CASE WHEN importance >= 0 THEN rr ELSE rr + 5 END AS position FROM r
      WHERE (importance >= 0 AND rr <= 5) OR (importance < 0 AND rr <= 3)),
d AS (SELECT * FROM (VALUES ('quantity', 'Packets carried by the flow.'), ('price', 'Bytes carried by the flow.'),
                            ('discount', 'Share of retransmitted segments.')) v(feature, description))
SELECT alert_id, CAST(position AS INTEGER) AS position, feature, ROUND(value, 3) + 0.0 AS value,
       ROUND(importance, 4) + 0.0 AS importance,
       coalesce(description, 'No description is kept for this feature.') AS description,
       CASE WHEN importance > 0 THEN 'increased the attack score'
            ELSE 'decreased the attack score (pushed toward benign)' END AS direction,
       {_bands('value', True)} AS value_summary,
       printf('%s (%s, importance: %.4f)', feature, {_bands('value', True)}, abs(importance)) AS plain_english,
       printf('- **%s** was %s (%.2f), which %s (importance: %.4f)', feature, {_bands('value', False)}, value,
              CASE WHEN importance > 0 THEN 'pushed toward **attack**' ELSE 'pushed toward **benign**' END,
              abs(importance)) AS summary_line
FROM t LEFT JOIN d USING (feature)""")
def alert_explanations(spark, sf_dir):
    """Per alert the top-5 positive then top-3 negative
    contributions with bands, direction, description and text lines."""
    top = ex.split_top(_contributions(spark, sf_dir), 5, 3)
    desc = spark.createDataFrame(list(FEATURE_TEXT.items()), "feature string, description string")
    rows = ex.explanation_rows(top, desc)
    return rows.withColumn("position", F.col("position").cast("int"))


@register("alert_documents", sql=f"""{CONTRIB_SQL}, {PREDICTIONS_CTE},
r AS (SELECT *, row_number() OVER (PARTITION BY alert_id, importance >= 0
              ORDER BY CASE WHEN importance >= 0 THEN -importance ELSE importance END, feature) AS rr FROM contrib),
t AS (SELECT *, CASE WHEN importance >= 0 THEN rr ELSE rr + 5 END AS position FROM r
      WHERE (importance >= 0 AND rr <= 5) OR (importance < 0 AND rr <= 3)),
k AS (SELECT alert_id, count(*) AS n_shown, string_agg(feature, ';' ORDER BY position) AS shown,
             string_agg(printf('- **%s** was %s (%.2f), which %s (importance: %.4f)', feature, {_bands('value', False)}, value,
                        CASE WHEN importance > 0 THEN 'pushed toward **attack**' ELSE 'pushed toward **benign**' END,
                        abs(importance)), chr(10) ORDER BY position) AS details FROM t GROUP BY alert_id),
a AS (SELECT alert_id, string_agg(feature, ';' ORDER BY feature) AS every FROM contrib GROUP BY alert_id)
SELECT alert_id, CASE WHEN y_true = 1 THEN 'Attack' ELSE 'Benign' END AS true_label, CASE WHEN y_pred = 1 THEN 'Attack' ELSE 'Benign' END AS predicted,
       printf('Classified as **%s** with a confidence of %.2f%%, which is **%s** (true label: %s).', CASE WHEN y_pred = 1 THEN 'Attack' ELSE 'Benign' END,
              y_score * 100, CASE WHEN y_pred = y_true THEN 'right' ELSE 'wrong' END, CASE WHEN y_true = 1 THEN 'Attack' ELSE 'Benign' END) AS summary,
       details, n_shown, shown, every
FROM preds JOIN k ON k.alert_id = preds.row_id JOIN a USING (alert_id)""")
def alert_documents(spark, sf_dir):
    """The whole explanation document of every alert (nested; flat
    here to be compared)."""
    desc = spark.createDataFrame(list(FEATURE_TEXT.items()), "feature string, description string")
    v = ex.verdict_text(predictions(spark, sf_dir), "y_true", "y_pred").select(
        F.col("row_id").alias("alert_id"), "true_text", "predicted_text", "correct", F.col("y_score").alias("probability"))
    d = ex.explanation_documents(_contributions(spark, sf_dir), v, desc)
    return d.select("alert_id", "true_label", "predicted", "summary", F.array_join("details", "\n").alias("details"),
                    F.size("features").cast("bigint").alias("n_shown"), F.array_join("features.feature", ";").alias("shown"),
                    F.array_join("all_features.feature", ";").alias("every"))


@register("alert_narrative", sql=f"""{CONTRIB_SQL},
w AS (SELECT alert_id, feature, CASE WHEN sum(abs(importance)) OVER (PARTITION BY alert_id) = 0 THEN 0
             ELSE abs(importance) / sum(abs(importance)) OVER (PARTITION BY alert_id) END AS weight FROM contrib),
r AS (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY -weight, feature) AS rn FROM w)
SELECT alert_id, 'Alert triggered primarily by: '
       || string_agg(printf('%s (%.1f%% contribution)', feature, weight * 100), ', ' ORDER BY rn) || '.'
       || ' Classification: Attack.' AS narrative
FROM r WHERE rn <= 3 GROUP BY alert_id""")
def alert_narrative(spark, sf_dir):
    """One sentence per alert over its top-3 features."""
    n = ex.narratives(_contributions(spark, sf_dir), 3, F.lit("Attack"))
    return n


@register("proxy_explanations", sql=f"""{CONTRIB_SQL},
g AS (SELECT feature, avg(abs(importance)) AS imp FROM contrib GROUP BY feature),
top AS (SELECT * FROM g ORDER BY imp DESC, feature LIMIT 10)
SELECT alert_id, string_agg(feature, ';' ORDER BY -imp, feature) AS features, ROUND(sum(value * imp), 6) + 0.0 AS weighted
FROM contrib JOIN top USING (feature) GROUP BY alert_id""")
def proxy_explanations(spark, sf_dir):
    """Global top-10 importances repeated per alert with its values."""
    c = _contributions(spark, sf_dir)
    imp = ex.global_importance(c)
    p = ex.proxy_explanations("alert_id", c.select("alert_id", "feature", "value"), imp, 10)
    return p.select("alert_id", F.array_join(F.transform("features", lambda s: s["feature"]), ";").alias("features"),
                    r6(F.aggregate("features", F.lit(0.0), lambda a, s: a + s["value"] * s["importance"]), "weighted"))


@register("alert_table", sql=f"""WITH {PREDICTIONS_CTE}, {FLOWS_CTE}
SELECT p.row_id AS alert_idx, CASE WHEN y_true = 1 THEN 'Attack' ELSE 'Benign' END AS true_label,
       CASE WHEN y_pred = 1 THEN 'Attack' ELSE 'Benign' END AS predicted, ROUND(y_score, 4) AS probability,
       ROUND(CAST(dst_port AS DOUBLE), 4) AS destination_port, ROUND(quantity, 4) AS quantity,
       ROUND(price, 4) AS price
FROM preds p JOIN flows f USING (row_id) ORDER BY p.row_id LIMIT 12""")
def alert_table(spark, sf_dir):
    """The first 12 alerts (by id) with verdict texts, probability
    and named features, joined on the alert id."""
    p = predictions(spark, sf_dir)
    f = flows(spark, sf_dir).select("row_id", "dst_port", "quantity", "price")
    t = ex.verdict_text(p, "y_true", "y_pred").join(f, "row_id")
    return t.orderBy("row_id").limit(12).select(
        F.col("row_id").alias("alert_idx"), F.col("true_text").alias("true_label"),
        F.col("predicted_text").alias("predicted"), rnd("y_score", 4).alias("probability"),
        rnd(F.col("dst_port").cast("double"), 4).alias("destination_port"), rnd("quantity", 4).alias("quantity"),
        rnd("price", 4).alias("price"))


@register("threshold_bands", sql=f"""WITH {PREDICTIONS_CTE},
r AS (SELECT group_key, CASE WHEN count(*) FILTER (WHERE y_true = 1) = 0 THEN 0
              ELSE count(*) FILTER (WHERE y_true = 1 AND y_pred = 1) / count(*) FILTER (WHERE y_true = 1) END AS rate
      FROM preds GROUP BY group_key)
SELECT group_key, ROUND(rate, 6) AS detection_rate,
       CASE WHEN rate < 0.95 THEN 'red' WHEN rate < 0.99 THEN 'yellow' ELSE 'green' END AS band FROM r""")
def threshold_bands(spark, sf_dir):
    """Detection-rate colour per group (red < 0.95 <= yellow < 0.99 <= green)."""
    m = mt.binary_metrics(predictions(spark, sf_dir), ["group_key"])
    return m.select("group_key", r6("recall", "detection_rate"),
                    band("recall", [0.95, 0.99], ["red", "yellow", "green"]).alias("band"))


@register("alert_bands", sql=f"""{CAPTURE_ALERTS_SQL}
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS alerts,
       CASE WHEN count(*) < 10 THEN 'green' WHEN count(*) < 50 THEN 'yellow' ELSE 'red' END AS band
FROM alerts GROUP BY date_trunc('hour', ts)""")
def alert_bands(spark, sf_dir):
    """Capture alerts per hour with the 10/50 colour bands."""
    a = pk.capture_alerts(packets(spark, sf_dir))
    h = a.groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.count(F.lit(1)).alias("alerts"))
    return h.select(F.date_format("h", "yyyy-MM-dd HH:mm:ss").alias("hour"), "alerts",
                    band("alerts", [10, 50], ["green", "yellow", "red"]).alias("band"))


@register("metric_series", sql=f"""{CAPTURE_ALERTS_SQL}
SELECT 'packet_rate' AS target, ROUND(count(*) / 3600.0, 6) AS value, epoch_ms(date_trunc('hour', ts)) AS ts_ms,
       CAST(NULL AS VARCHAR) AS tag FROM packets GROUP BY date_trunc('hour', ts)
UNION ALL
SELECT 'active_alerts', CAST(count(*) AS DOUBLE), epoch_ms(date_trunc('hour', ts)), NULL FROM alerts
GROUP BY date_trunc('hour', ts)
UNION ALL
SELECT 'protocol_distribution', CAST(count(*) AS DOUBLE), epoch_ms(date_trunc('day', ts)), proto FROM packets
GROUP BY date_trunc('day', ts), proto""")
def metric_series(spark, sf_dir):
    """K7: long-form time series (target, value, ts_ms, tag) computed from the
    stream: hourly packet rate and alert counts, daily protocol mix."""
    p = packets(spark, sf_dir)
    a = pk.capture_alerts(p)
    hour = F.date_trunc("hour", "ts")
    ms = lambda c: (F.unix_micros(c) / 1000).cast("bigint")
    rate = p.groupBy(hour.alias("h")).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("packet_rate").alias("target"), r6(F.col("n") / 3600.0, "value"), ms("h").alias("ts_ms"),
        F.lit(None).cast("string").alias("tag"))
    alerts = a.groupBy(hour.alias("h")).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("active_alerts").alias("target"), F.col("n").cast("double").alias("value"), ms("h").alias("ts_ms"),
        F.lit(None).cast("string").alias("tag"))
    mix = p.groupBy(F.date_trunc("day", "ts").alias("h"), "proto").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("protocol_distribution").alias("target"), F.col("n").cast("double").alias("value"),
        ms("h").alias("ts_ms"), F.col("proto").alias("tag"))
    return rate.unionByName(alerts).unionByName(mix)


@register("recon_error_threshold", sql=f"""WITH {FLOWS_CTE},
p AS (SELECT avg(quantity) AS mq, stddev_pop(quantity) AS sq, avg(price) AS mp, stddev_pop(price) AS sp,
             avg(discount) AS md, stddev_pop(discount) AS sd, avg(tax) AS mt, stddev_pop(tax) AS st FROM flows),
e AS (SELECT label, ((quantity - mq) / sq) ^ 2 + ((price - mp) / sp) ^ 2 + ((discount - md) / sd) ^ 2
                    + ((tax - mt) / st) ^ 2 AS err FROM flows, p),
t AS (SELECT quantile_cont(err, 0.95) AS thr_all, quantile_cont(err, 0.95) FILTER (WHERE label = 0) AS thr_benign FROM e)
SELECT ROUND(thr_all, 6) AS threshold_all, ROUND(thr_benign, 6) AS threshold_benign,
       count(*) FILTER (WHERE err > thr_all) AS flagged_all, count(*) FILTER (WHERE err > thr_benign) AS flagged_benign
FROM e, t GROUP BY thr_all, thr_benign""")
def recon_error_threshold(spark, sf_dir):
    """95th-percentile threshold of a reconstruction error (here the
    rank-0 reconstruction: squared z-distance to the mean), over all rows and
    over benign rows only; rows above are flagged."""
    f = flows(spark, sf_dir).select("label", *NUM)
    z, _ = prep.normalize(f, NUM, "zscore")
    e = z.select("label", sum((F.col(c) ** 2 for c in NUM[1:]), F.col(NUM[0]) ** 2).alias("err"))
    long = (e.select(F.lit("all").alias("base"), F.lit("err").alias("c_name"), F.col("err").alias("v"))
            .unionByName(e.filter("label = 0").select(F.lit("benign").alias("base"), F.lit("err").alias("c_name"),
                                                      F.col("err").alias("v"))))
    q = quantiles_long(long, [0.95], ["base"])
    thr = q.groupBy().pivot("base", ["all", "benign"]).agg(F.first("value"))
    j = e.crossJoin(F.broadcast(thr))
    return j.groupBy("all", "benign").agg(
        F.count(F.when(F.col("err") > F.col("all"), 1)).alias("flagged_all"),
        F.count(F.when(F.col("err") > F.col("benign"), 1)).alias("flagged_benign")).select(
        r6("all", "threshold_all"), r6("benign", "threshold_benign"), "flagged_all", "flagged_benign")
