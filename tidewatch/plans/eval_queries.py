"""Evaluation metrics and statistical tests over the predictions hub."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as mt
from ..operators import packets as pk
from ..operators import stats as st
from ..sources.tables import table
from ..sources.views import packets, predictions
from .common import r6, rnd
from .registry import register
from .sql_views import PACKETS_CTE, PREDICTIONS_CTE

WP = f"WITH {PREDICTIONS_CTE}"
CM_SQL = """count(*) FILTER (WHERE y_true = 0 AND y_pred = 0) AS tn, count(*) FILTER (WHERE y_true = 0 AND y_pred = 1) AS fp,
       count(*) FILTER (WHERE y_true = 1 AND y_pred = 0) AS fn, count(*) FILTER (WHERE y_true = 1 AND y_pred = 1) AS tp"""


def _metric_sql(src: str, by: str = "") -> str:
    grp = f"GROUP BY {by}" if by else ""
    sel = f"{by}, " if by else ""
    return f"""c AS (SELECT {sel}{CM_SQL} FROM {src} {grp})
SELECT {sel}tn, fp, fn, tp,
  ROUND(CASE WHEN tn+fp+fn+tp = 0 THEN 0 ELSE (tp+tn)/(tn+fp+fn+tp) END, 6) AS accuracy,
  ROUND(CASE WHEN tp+fp = 0 THEN 0 ELSE tp/(tp+fp) END, 6) AS precision,
  ROUND(CASE WHEN tp+fn = 0 THEN 0 ELSE tp/(tp+fn) END, 6) AS recall,
  ROUND(CASE WHEN 2*tp+fp+fn = 0 THEN 0 ELSE 2*tp/(2*tp+fp+fn) END, 6) AS f1,
  ROUND(CASE WHEN fp+tn = 0 THEN 0 ELSE fp/(fp+tn) END, 6) AS fpr,
  ROUND(CASE WHEN fn+tp = 0 THEN 0 ELSE fn/(fn+tp) END, 6) AS fnr FROM c"""


def _round_metrics(df, keys=()):
    return df.select(*keys, "tn", "fp", "fn", "tp",
                     *[r6(c, c) for c in ("accuracy", "precision", "recall", "f1", "fpr", "fnr")])


@register("confusion", sql=f"{WP} SELECT {CM_SQL} FROM preds")
def confusion(spark, sf_dir):
    return mt.confusion(predictions(spark, sf_dir))


@register("binary_metrics", sql=f"{WP}, {_metric_sql('preds')}")
def binary_metrics(spark, sf_dir):
    """Accuracy, precision, recall, F1, FPR, FNR (zero_division=0)."""
    return _round_metrics(mt.binary_metrics(predictions(spark, sf_dir)))


@register("metrics_by_group", sql=f"{WP}, {_metric_sql('preds', 'group_key')}")
def metrics_by_group(spark, sf_dir):
    """E19 shape: the same metrics per group key (e.g. per retraining cycle)."""
    return _round_metrics(mt.binary_metrics(predictions(spark, sf_dir), ["group_key"]), ["group_key"])


AUC_SQL = f"""{WP},
sc AS (SELECT y_score AS score, count(*) FILTER (WHERE y_true = 1) AS pos, count(*) FILTER (WHERE y_true <> 1) AS neg
       FROM preds GROUP BY y_score),
c AS (SELECT *, sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM sc)
SELECT ROUND(sum(pos * (coalesce(below, 0) + 0.5 * neg)) / (sum(pos) * sum(neg)), 8) AS auc FROM c"""


@register("auc_exact", sql=AUC_SQL)
def auc_exact(spark, sf_dir):
    """Exact Mann-Whitney AUC with tie-averaged ranks."""
    a = mt.auc_exact(predictions(spark, sf_dir))
    return a.select(rnd("auc", 8).alias("auc"))


ROC_SQL = f"""{WP},
sc AS (SELECT y_score AS score, count(*) FILTER (WHERE y_true = 1) AS pos, count(*) FILTER (WHERE y_true <> 1) AS neg
       FROM preds GROUP BY y_score),
c AS (SELECT score, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
             sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM sc)"""


@register("roc_points", sql=f"""{ROC_SQL}
SELECT ROUND(score, 6) AS score, ROUND(fp / N, 6) AS fpr, ROUND(tp / P, 6) AS tpr, CAST(tp AS BIGINT) AS tp,
       CAST(fp AS BIGINT) AS fp FROM c""")
def roc_points(spark, sf_dir):
    """One ROC point per distinct score (thresholds descending)."""
    p = mt.roc_points(predictions(spark, sf_dir))
    return p.select(r6("score", "score"), r6("fpr", "fpr"), r6("tpr", "tpr"), "tp", "fp")


@register("roc_auc_trapezoid", sql=f"""{ROC_SQL},
p AS (SELECT fp / N AS fpr, tp / P AS tpr, score FROM c),
l AS (SELECT *, coalesce(lag(fpr) OVER (ORDER BY score DESC), 0) AS pf,
             coalesce(lag(tpr) OVER (ORDER BY score DESC), 0) AS pt FROM p)
SELECT ROUND(sum((fpr - pf) * (tpr + pt) / 2), 8) AS auc_trapezoid FROM l""")
def roc_auc_trapezoid(spark, sf_dir):
    """Trapezoid area from the origin through every point."""
    pts = mt.roc_points(predictions(spark, sf_dir))
    return mt.roc_auc_trapezoid(pts).select(rnd("auc_trapezoid", 8).alias("auc_trapezoid"))


@register("pr_average_precision", sql=f"""{ROC_SQL},
x AS (SELECT (tp - coalesce(lag(tp) OVER (ORDER BY score DESC), 0)) / P * tp / (tp + fp) AS x FROM c)
SELECT ROUND(sum(x), 8) AS average_precision FROM x""")
def pr_average_precision(spark, sf_dir):
    """AP = sum (R_n - R_{n-1}) P_n."""
    ap = mt.average_precision(predictions(spark, sf_dir))
    return ap.select(rnd("average_precision", 8).alias("average_precision"))


@register("model_comparison", sql=f"""{WP},
long AS (SELECT 'a' AS model, y_true, y_pred, y_score FROM preds
         UNION ALL SELECT 'b', y_true, y_pred_b, CAST(y_pred_b AS DOUBLE) FROM preds),
sc AS (SELECT model, y_score AS score, count(*) FILTER (WHERE y_true = 1) AS pos,
              count(*) FILTER (WHERE y_true <> 1) AS neg FROM long GROUP BY model, y_score),
cu AS (SELECT *, sum(neg) OVER (PARTITION BY model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
              AS below FROM sc),
auc AS (SELECT model, ROUND(sum(pos * (coalesce(below, 0) + 0.5 * neg)) / (sum(pos) * sum(neg)), 8) AS auc
        FROM cu GROUP BY model),
{_metric_sql('long', 'model').replace("FROM c", "FROM c JOIN auc USING (model)").replace(
    "AS fnr FROM", "AS fnr, auc FROM")}""")
def model_comparison(spark, sf_dir):
    """One row per model (a: quantity score, b: discount rule)."""
    p = predictions(spark, sf_dir)
    a = p.select("y_true", "y_pred", "y_score")
    b = p.select("y_true", F.col("y_pred_b").alias("y_pred"), F.col("y_pred_b").cast("double").alias("y_score"))
    mc = mt.model_comparison(mt.long_form({"a": a, "b": b}))
    return mc.select("model", "tn", "fp", "fn", "tp",
                     *[r6(c, c) for c in ("accuracy", "precision", "recall", "f1", "fpr", "fnr")], rnd("auc", 8).alias("auc"))


@register("masked_metrics", sql=f"""{WP},
m AS (SELECT count(*) FILTER (WHERE y_pred = 1) AS tp, count(*) FILTER (WHERE y_pred = 0) AS fn FROM preds WHERE y_true = 1)
SELECT ROUND(CASE WHEN tp = 0 THEN 0 ELSE 1.0 END, 6) AS mitm_precision,
       ROUND(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS mitm_recall,
       ROUND(CASE WHEN 2 * tp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fn) END, 6) AS mitm_f1 FROM m""")
def masked_metrics(spark, sf_dir):
    """E5: metrics on attack rows only (precision is 1 whenever anything is caught)."""
    m = mt.masked_metrics(predictions(spark, sf_dir), F.col("y_true") == 1)
    return m.select(*[r6(c, c) for c in m.columns])


@register("mcnemar", sql=f"""{WP},
bc AS (SELECT count(*) FILTER (WHERE y_pred <> y_true AND y_pred_b = y_true) AS b,
              count(*) FILTER (WHERE y_pred = y_true AND y_pred_b <> y_true) AS c FROM preds)
SELECT b, c, ROUND(CASE WHEN b + c = 0 THEN 0 ELSE (abs(b - c) - 1) ^ 2 / (b + c) END, 6) AS statistic FROM bc""")
def mcnemar(spark, sf_dir):
    """Statistic is oracle-checked; p-value is unit-tested."""
    m = st.mcnemar(predictions(spark, sf_dir))
    return m.select("b", "c", r6("statistic", "statistic"))


@register("kappa", sql="""WITH c AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM labels GROUP BY ALL),
t AS (SELECT sum(n) AS n, sum(n) FILTER (WHERE a = b) AS agree FROM c),
ma AS (SELECT a AS cls, sum(n) AS ra FROM c GROUP BY a), mb AS (SELECT b AS cls, sum(n) AS rb FROM c GROUP BY b),
pe AS (SELECT sum(ra * rb) AS pe_num FROM ma JOIN mb USING (cls))
SELECT ROUND((coalesce(agree, 0) / n - pe_num / (n * n)) / (1 - pe_num / (n * n)), 6) AS kappa FROM t, pe""")
def kappa(spark, sf_dir):
    """Agreement between the quality and toxic labels."""
    k = st.cohens_kappa(table(spark, sf_dir, "labels"), "quality", "toxic")
    return k.select(r6("kappa", "kappa"))


@register("friedman", sql="""WITH cells AS (
  SELECT l_suppkey AS block, l_returnflag AS treatment, avg(l_quantity) AS score FROM lineitem GROUP BY ALL),
k AS (SELECT count(DISTINCT treatment) AS k FROM cells),
complete AS (SELECT block FROM cells GROUP BY block HAVING count(*) = (SELECT k FROM k)),
x AS (SELECT c.*, rank() OVER (PARTITION BY block ORDER BY score)
                  + (count(*) OVER (PARTITION BY block, score) - 1) / 2.0 AS r
      FROM cells c JOIN complete USING (block)),
ties AS (SELECT sum(t * t * t - t) AS tie_sum FROM (SELECT count(*) AS t FROM x GROUP BY block, score)),
rs AS (SELECT treatment, sum(r) AS R FROM x GROUP BY treatment),
agg AS (SELECT sum(R * R) AS sum_r2, count(*) AS k FROM rs),
nb AS (SELECT count(*) AS n FROM complete)
SELECT n, k, ROUND((12.0 / (n * k * (k + 1)) * sum_r2 - 3.0 * n * (k + 1)) / (1 - tie_sum / (n * k * (k * k - 1))), 6)
       AS statistic FROM agg, nb, ties""")
def friedman(spark, sf_dir):
    """blocks = suppliers, treatments = return flags, score = mean quantity."""
    li = table(spark, sf_dir, "lineitem")
    cells = li.groupBy(F.col("l_suppkey").alias("block"), F.col("l_returnflag").alias("treatment")).agg(
        F.avg("l_quantity").alias("score"))
    f = st.friedman(cells, "block", "treatment", "score")
    return f.select("n", "k", r6("statistic", "statistic"))


@register("latency_stats", sql=f"""WITH {PACKETS_CTE},
g AS (SELECT epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts, event_id)) AS gap FROM packets)
SELECT ROUND(avg(gap) / 1000.0, 6) AS mean_latency_ms, ROUND(max(gap) / 1000.0, 6) AS max_latency_ms,
       ROUND(min(gap) / 1000.0, 6) AS min_latency_ms FROM g WHERE gap IS NOT NULL""")
def latency_stats(spark, sf_dir):
    """Consecutive gaps over the whole stream, without a global sort."""
    s = pk.latency_stats(packets(spark, sf_dir))
    return s.select(*[r6(c, c) for c in s.columns])
