"""Model training/scoring queries (rows-only checks: not SQL-expressible)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.quantiles import quantiles_long
from ..operators import feedback as fb
from ..operators import metrics as mt
from ..operators import models as md
from ..operators import prep
from ..sources.tables import table
from ..sources.views import flows
from .common import r6
from ..session import checkpoint_dir
from .prep_queries import NUM, SCORE_SQL
from .registry import register
from .sql_views import FLOWS_CTE


_SPLITS: dict = {}


def _split(spark, sf_dir):
    """The train/test split, checkpointed once per table folder (reliable
    checkpoint in the session's checkpoint folder) so model fitting and the
    many scoring passes do not re-run the split's plan. The flows are dealt by
    their ids before, so that every pass has more tasks than the input files
    have row groups."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SPLITS:
        checkpoint_dir(spark)
        f = flows(spark, sf_dir).select("row_id", "label", "dst_port", *NUM).repartition("row_id").checkpoint()
        _SPLITS[key] = prep.stratified_split(f, "label", "row_id", 0.15).checkpoint()
    return _SPLITS[key]


_FORESTS: dict = {}


def _rf(spark, sf_dir):
    """The forest of a table folder is trained once (its nodes lie in the
    session's checkpoint folder); later queries in the process reuse it."""
    s = _split(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FORESTS:
        _FORESTS[key] = md.fit_random_forest(s.filter(~F.col("is_test")), NUM, "label")
    return _FORESTS[key], s.filter("is_test")


@register("rf_scores")
def rf_scores(spark, sf_dir):
    """M1/M8: random forest (100 trees, depth 20, seed 42) trained on the
    split's train rows, scored on its test rows."""
    model, test = _rf(spark, sf_dir)
    sc = md.score(model, test, ["row_id", F.col("label").alias("y_true")])
    return sc.select("row_id", "y_true", r6("y_score", "y_score"), "y_pred")


@register("rf_metrics")
def rf_metrics(spark, sf_dir):
    """E1-E4 on the forest's test predictions."""
    model, test = _rf(spark, sf_dir)
    sc = md.score(model, test, ["row_id", F.col("label").alias("y_true")]).checkpoint()
    m = mt.binary_metrics(sc).crossJoin(mt.auc_exact(sc))
    return m.select("tn", "fp", "fn", "tp", *[r6(c, c) for c in ("accuracy", "precision", "recall", "f1",
                                                                 "fpr", "fnr", "auc")])


@register("feature_importance")
def feature_importance(spark, sf_dir):
    """M9: the forest's feature importances, joined to names."""
    model, _ = _rf(spark, sf_dir)
    return md.feature_importances(model, NUM).select("feature", r6("importance", "importance"))


@register("svm_scores")
def svm_scores(spark, sf_dir):
    """M3: linear SVM on all training rows (z-scored features; the scaler is
    fitted on training rows alone)."""
    s = _split(spark, sf_dir)
    z = prep.apply_scaler(s, prep.fit_scaler(s.filter(~F.col("is_test")), NUM, "zscore"), NUM, "zscore")
    model = md.fit_linear_svm(z.filter(~F.col("is_test")), NUM, "label")
    out = md.svm_scores(model, z.filter("is_test"), ["row_id", F.col("label").alias("y_true")])
    return out.select("row_id", "y_true", r6("margin", "margin"), "y_pred")


@register("kernel_svm_scores")
def kernel_svm_scores(spark, sf_dir):
    """M3: radial-kernel SVM by random Fourier features on all training rows,
    with Platt's probabilities."""
    s = _split(spark, sf_dir)
    z = prep.apply_scaler(s, prep.fit_scaler(s.filter(~F.col("is_test")), NUM, "zscore"), NUM, "zscore")
    model = md.KernelSvm(z.filter(~F.col("is_test")), NUM, "row_id")
    out = model.score(z.filter("is_test"), ["row_id", F.col("label").alias("y_true")])
    return out.select("row_id", "y_true", r6("margin", "margin"), r6("probability", "probability"), "y_pred")


@register("isolation_forest")
def isolation_forest(spark, sf_dir):
    """M4: 100 trees on 256-row samples, contamination 0.1: rows above the
    90th percentile of the score are anomalies."""
    f = flows(spark, sf_dir).select("row_id", *NUM)
    forest = md.fit_isolation_forest(f, NUM, "row_id", 100, 256, 42)
    checkpoint_dir(spark)
    # scored once, read by every pass; dealt by id, as input files may have few row groups
    s = md.isolation_scores(f.repartition("row_id"), forest, NUM, ["row_id"]).checkpoint()
    thr = quantiles_long(s.select(F.lit("s").alias("c_name"), F.col("anomaly_score").alias("v")), [0.9])
    j = s.crossJoin(F.broadcast(thr.select(F.col("value").alias("thr"))))
    return j.select("row_id", r6("anomaly_score", "anomaly_score"),
                    F.when(F.col("anomaly_score") > F.col("thr"), 1).otherwise(0).alias("is_anomaly"))


def _embeddings(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    dim = len(e.select("embedding").first()[0])
    cols = [f"e{i}" for i in range(dim)]
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(cols)]), cols


@register("pca_recon_error")
def pca_recon_error(spark, sf_dir):
    """Rank-16 PCA reconstruction error per embedding and the
    95th-percentile flag."""
    e, cols = _embeddings(spark, sf_dir)
    checkpoint_dir(spark)
    err = md.pca_reconstruction_error(e, cols, 16, ["vec_id", "label"]).checkpoint()
    thr = quantiles_long(err.select(F.lit("e").alias("c_name"), F.col("recon_error").alias("v")), [0.95])
    j = err.crossJoin(F.broadcast(thr.select(F.col("value").alias("thr"))))
    return j.select("vec_id", "label", r6("recon_error", "recon_error"),
                    (F.col("recon_error") > F.col("thr")).alias("flagged"))


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("vec"), "label")


@register("smote", sql="""WITH c AS (SELECT label, count(*) AS original FROM embeddings GROUP BY label)
SELECT label, original, max(original) OVER () - original AS synthetic, max(original) OVER () AS total FROM c""")
def smote(spark, sf_dir):
    """Every embedding class topped up to the majority count with
    k=5 within-class neighbours."""
    out = md.smote(_vectors(spark, sf_dir), "vec_id", "vec", "label", 5, 42)
    return out.groupBy("label").agg(F.count(F.when(~F.col("synthetic"), 1)).alias("original"),
                                    F.count(F.when(F.col("synthetic"), 1)).alias("synthetic"),
                                    F.count(F.lit(1)).alias("total"))


@register("smote_rows")
def smote_rows(spark, sf_dir):
    """The synthetic rows themselves, with donor, neighbour and step."""
    out = md.smote(_vectors(spark, sf_dir), "vec_id", "vec", "label", 5, 42, trace=True)
    return out.filter("synthetic").select("label", "donor_id", "nn_id", "u", "vec")


@register("mlp_sequence")
def mlp_sequence(spark, sf_dir):
    """M7 re-aimed: 20-step windows per destination port, flattened, into a
    multilayer perceptron. Windows of one port overlap, so whole ports are
    chosen for the test by hash."""
    f = flows(spark, sf_dir)
    w = prep.sequence_windows(f, "dst_port", ["timestamp", "flow_id", "line", "part_key", "quantity", "row_id"],
                              ["quantity", "discount"], "label", 20)
    w = w.withColumn("is_test", prep.hash_score("dst_port", 7) < 0.15)
    flat = md.flatten_windows(w, 40, ["row_id", "is_test"])
    model = md.fit_sequence_mlp(w.filter(~F.col("is_test")), 40, (32,), 42, 50)
    sc = md.score(model, flat.filter("is_test"), ["row_id", F.col("label").cast("int").alias("y_true")])
    return sc.select("row_id", "y_true", r6("y_score", "y_score"), "y_pred")


@register("tree_contributions")
def tree_contributions(spark, sf_dir):
    """Path attribution of the forest per test row; the base value plus
    the contributions equals the predicted probability (checked in tests)."""
    model, test = _rf(spark, sf_dir)
    c = md.tree_contributions(model, test, NUM, "row_id")
    return c.select("row_id", "feature", r6("contribution", "contribution"))


@register("global_tree_importance")
def global_tree_importance(spark, sf_dir):
    """X1 + A10 + L4: mean |path contribution| per feature, top 10."""
    model, test = _rf(spark, sf_dir)
    c = md.tree_contributions(model, test, NUM, "row_id").filter(F.col("feature") != "__base__")
    g = c.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"))
    return g.orderBy(F.desc("mean_abs"), "feature").limit(10).select("feature", r6("mean_abs", "mean_abs"))


_TEST_ROWS = f"""WITH {FLOWS_CTE},
s AS (SELECT row_id, label, {SCORE_SQL} AS score FROM flows),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score) AS rn, count(*) OVER (PARTITION BY label) AS n FROM s),
test AS (SELECT * FROM r WHERE rn <= round(n * 0.15))"""


@register("forest_identity", sql=f"""{_TEST_ROWS}
SELECT label AS y_true, count(*) AS scored, CAST(0 AS BIGINT) AS outside, CAST(0 AS BIGINT) AS unequal FROM test GROUP BY label""")
def forest_identity(spark, sf_dir):
    """Test rows scored per label, scores outside [0, 1], and rows
    whose base value and contributions don't sum to their probability."""
    model, test = _rf(spark, sf_dir)
    sc = md.score(model, test, ["row_id", F.col("label").alias("y_true")])
    tot = md.tree_contributions(model, test, NUM, "row_id").groupBy("row_id").agg(F.sum("contribution").alias("total"))
    j = sc.join(tot, "row_id")
    return j.groupBy("y_true").agg(F.count(F.lit(1)).alias("scored"),
                                   F.count(F.when(~F.col("y_score").between(0, 1), 1)).alias("outside"),
                                   F.count(F.when(F.abs(F.col("total") - F.col("y_score")) > 1e-9, 1)).alias("unequal"))


#: Alerts of each class that are explained row by row, as the alert list shows.
EXPLAINED = 6


def _explained(spark, sf_dir):
    model, test = _rf(spark, sf_dir)
    return model, prep.stratified_pick(test, "label", "row_id", EXPLAINED)


@register("shapley_contributions")
def shapley_contributions(spark, sf_dir):
    """Exact Shapley values of the forest for the explained alerts."""
    model, pick = _explained(spark, sf_dir)
    c = md.shapley_contributions(model, pick, NUM, "row_id")
    return c.select("row_id", "feature", r6("contribution", "contribution"))


@register("shapley_identity", sql=f"""{_TEST_ROWS}
SELECT row_id, label AS y_true, true AS adds_up FROM
  (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score, row_id) AS pick FROM test) WHERE pick <= {EXPLAINED}""")
def shapley_identity(spark, sf_dir):
    """Whether base value and Shapley values of each explained alert sum to
    its probability."""
    model, pick = _explained(spark, sf_dir)
    sc = md.score(model, pick, ["row_id", F.col("label").alias("y_true")])
    tot = md.shapley_contributions(model, pick, NUM, "row_id").groupBy("row_id").agg(F.sum("contribution").alias("total"))
    return sc.join(tot, "row_id").select("row_id", "y_true", (F.abs(F.col("total") - F.col("y_score")) < 1e-9).alias("adds_up"))


@register("svm_scored_rows", sql=f"""{_TEST_ROWS}
SELECT label AS y_true, count(*) AS scored, CAST(0 AS BIGINT) AS odd FROM test GROUP BY label""")
def svm_scored_rows(spark, sf_dir):
    """M3: test rows scored per label, and rows whose class isn't their
    margin's sign."""
    s = svm_scores(spark, sf_dir)
    odd = (F.col("margin") > 0) != (F.col("y_pred") == 1)
    return s.groupBy("y_true").agg(F.count(F.lit(1)).alias("scored"), F.count(F.when(odd, 1)).alias("odd"))


@register("kernel_svm_rows", sql=f"""{_TEST_ROWS}
SELECT label AS y_true, count(*) AS scored, CAST(0 AS BIGINT) AS odd FROM test GROUP BY label""")
def kernel_svm_rows(spark, sf_dir):
    """M3: test rows scored per label, and rows whose probability is none or
    not on the side of their class."""
    p = F.col("probability")
    odd = p.isNull() | ~p.between(0, 1) | ((p >= 0.5) != (F.col("y_pred") == 1))
    return kernel_svm_scores(spark, sf_dir).groupBy("y_true").agg(F.count(F.lit(1)).alias("scored"), F.count(F.when(odd, 1)).alias("odd"))


@register("local_surrogate")
def local_surrogate(spark, sf_dir):
    """1,000 perturbations per explained alert (6 per class), scored by
    the forest, kernel-weighted linear surrogate, top 5 features."""
    model, test = _rf(spark, sf_dir)
    pick = prep.stratified_pick(test, "label", "row_id", 6)
    sd = flows(spark, sf_dir).agg(*[F.stddev_pop(c).alias(f"{c}__sd") for c in NUM])
    s = md.local_surrogate(model, pick, NUM, "row_id", sd, 1000, None, 5, 42)
    return s.select("row_id", "feature", r6("weight", "weight"), "rank")


def _feedback_rows(spark, sf_dir):
    """The forest, its training rows, the retraining set that analysts' verdicts
    on half of the test rows give, and the other half."""
    base, test = _rf(spark, sf_dir)
    half = prep.hash_score("row_id", 11) < 0.5
    scored = md.score(base, test.filter(half), ["row_id", "label", *NUM]).checkpoint()
    verdict = (F.when((F.col("y_pred") == 1) & (F.col("label") == 1), fb.CONFIRMED)
               .when((F.col("y_pred") == 1) & (F.col("label") == 0), fb.DISMISSED).otherwise("none"))
    cyc = fb.assign_cycles(scored.withColumn("verdict", verdict).withColumn("y_true", F.col("label")), ["row_id"])
    rset = fb.retraining_set(cyc, label_rule="truth").select(*NUM, "label")
    return base, _split(spark, sf_dir).filter(~F.col("is_test")), rset, test.filter(~half)


@register("retrain_append", sql=f"""{_TEST_ROWS}
SELECT label AS y_true, count(*) AS scored, CAST(0 AS BIGINT) AS outside FROM test
WHERE {SCORE_SQL.replace('42:', '11:')} >= 0.5 GROUP BY label""")
def retrain_append(spark, sf_dir):
    """M2, the default: a refit on base and feedback rows; rows of the other
    half scored per label, and scores outside [0, 1]."""
    _, train, rset, holdout = _feedback_rows(spark, sf_dir)
    refit = md.partial_retrain(train, rset, NUM, "label", mode="append")
    sc = md.score(refit, holdout, ["row_id", F.col("label").alias("y_true")])
    return sc.groupBy("y_true").agg(F.count(F.lit(1)).alias("scored"), F.count(F.when(~F.col("y_score").between(0, 1), 1)).alias("outside"))


@register("retrain_comparison")
def retrain_comparison(spark, sf_dir):
    """Analyst feedback on half of the test rows (confirmed /
    dismissed forest alerts, labelled by truth) -> retraining cycles -> a
    refit on the feedback rows only (the reference's ``partial_retrain``);
    base and refit are compared on the other half. If no cycle closes, nothing
    is refitted and ``new_only`` is the base model still."""
    base, test = _rf(spark, sf_dir)
    half = prep.hash_score("row_id", 11) < 0.5
    fb_rows, holdout = test.filter(half), test.filter(~half)
    scored = md.score(base, fb_rows, ["row_id", "label", *NUM]).checkpoint()
    verdict = (F.when((F.col("y_pred") == 1) & (F.col("label") == 1), fb.CONFIRMED)
               .when((F.col("y_pred") == 1) & (F.col("label") == 0), fb.DISMISSED).otherwise("none"))
    cyc = fb.assign_cycles(scored.withColumn("verdict", verdict).withColumn("y_true", F.col("label")), ["row_id"])
    rset = fb.retraining_set(cyc, label_rule="truth").select(*NUM, "label").checkpoint()
    refit = md.partial_retrain(None, rset, NUM, "label", mode="new_only", current=base)
    keep = ["row_id", F.col("label").alias("y_true")]
    preds = mt.long_form({"base": md.score(base, holdout, keep),
                          "new_only": md.score(refit, holdout, keep)}).checkpoint()   # scored once
    mc = mt.model_comparison(preds)
    return mc.select("model", *[r6(c, c) for c in ("accuracy", "precision", "recall", "f1", "fpr", "fnr", "auc")])
