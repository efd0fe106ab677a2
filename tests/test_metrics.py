"""Metrics and statistics: properties and textbook constants."""

import itertools
import math
import random

from pyspark.sql import functions as F

from tidewatch.functions import stats as fs
from tidewatch.operators import metrics as mt
from tidewatch.operators import stats as st


def _preds(spark, n=400, seed=5):
    random.seed(seed)
    rows = [(i, random.randint(0, 1), round(random.random(), 2)) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, y_true int, y_score double").withColumn(
        "y_pred", (F.col("y_score") > 0.5).cast("int")), rows


def test_confusion_sums_to_n(spark):
    df, rows = _preds(spark)
    c = mt.confusion(df).first()
    assert c.tn + c.fp + c.fn + c.tp == len(rows)


def test_auc_matches_pairwise_and_is_monotone_invariant(spark):
    df, rows = _preds(spark)
    pos = [s for _, y, s in rows if y == 1]
    neg = [s for _, y, s in rows if y == 0]
    brute = sum((p > q) + 0.5 * (p == q) for p, q in itertools.product(pos, neg)) / (len(pos) * len(neg))
    a = mt.auc_exact(df, buckets=8).first().auc
    assert abs(a - brute) < 1e-12
    b = mt.auc_exact(df.withColumn("y_score", F.exp(F.col("y_score") * 3)), buckets=8).first().auc
    assert abs(a - b) < 1e-12


def test_average_precision_brute(spark):
    df, rows = _preds(spark, 200, 9)
    P = sum(y for _, y, _ in rows)
    ap = 0.0
    for t in sorted({s for *_, s in rows}, reverse=True):
        tp = sum(1 for _, y, s in rows if s >= t and y == 1)
        fp = sum(1 for _, y, s in rows if s >= t and y == 0)
        new = sum(1 for _, y, s in rows if s == t and y == 1)
        ap += new / P * tp / (tp + fp)
    assert abs(mt.average_precision(df, buckets=4).first().average_precision - ap) < 1e-12


def test_trapezoid_close_to_exact_auc(spark):
    df, _ = _preds(spark)
    pts = mt.roc_points(df)
    tr = mt.roc_auc_trapezoid(pts).first().auc_trapezoid
    assert abs(tr - mt.auc_exact(df).first().auc) < 1e-12


def test_zero_division_metrics(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y_true int, y_pred int")
    m = mt.binary_metrics(df).first()
    assert (m.precision, m.recall, m.f1, m.fnr, m.fpr, m.accuracy) == (0.0, 0.0, 0.0, 0.0, 0.0, 1.0)


def test_p_value_helpers_textbook():
    assert abs(fs.chi2_sf(3.841458820694124, 1) - 0.05) < 1e-12
    assert abs(fs.chi2_sf(5.991464547107979, 2) - 0.05) < 1e-12
    assert abs(fs.t_two_sided_p(2.0638985616280205, 24) - 0.05) < 1e-9
    assert abs(fs.t_two_sided_p(12.706204736174707, 1) - 0.05) < 1e-9
    assert abs(fs.normal_sf(1.959963984540054) - 0.025) < 1e-12


def test_mcnemar_counts_and_p(spark):
    rows = [(1, 0, 1)] * 10 + [(1, 1, 0)] * 4 + [(1, 1, 1)] * 20
    df = spark.createDataFrame(rows, "y_true int, y_pred int, y_pred_b int")
    r = st.mcnemar(df).first()
    assert (r.b, r.c) == (10, 4) and abs(r.statistic - 25 / 14) < 1e-12
    assert abs(r.p_value - fs.chi2_sf(25 / 14, 1)) < 1e-12


def test_kappa_perfect_and_chance(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (1, 1), (0, 0)], "a int, b int")
    assert st.cohens_kappa(df, "a", "b").first().kappa == 1.0


def test_paired_t_and_wilcoxon(spark):
    d = [0.1, -0.2, 0.3, 0.3, 0.5, 0.0, 0.25]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(d)], "user_id int, d double")
    t = st.paired_t(df).first()
    mean = sum(d) / len(d)
    sd = math.sqrt(sum((x - mean) ** 2 for x in d) / (len(d) - 1))
    assert abs(t.t_statistic - mean / (sd / math.sqrt(len(d)))) < 1e-12
    w = st.wilcoxon(df).first()
    # |d| ranks without the zero: .1->1, .2->2, .25->3, .3->4.5, .3->4.5, .5->6 ; W- = 2
    assert (w.n, w.w_minus, w.w_plus, w.statistic) == (6, 2.0, 19.0, 2.0)


def test_friedman_no_ties(spark):
    rows = [(b, t, float(s)) for b, scores in enumerate([[1, 2, 3], [1, 3, 2], [1, 2, 3], [2, 1, 3]])
            for t, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "block int, t int, score double")
    r = st.friedman(df, "block", "t", "score").first()
    R = [5, 8, 11]
    expect = 12 / (4 * 3 * 4) * sum(x * x for x in R) - 3 * 4 * 4
    assert abs(r.statistic - expect) < 1e-12


def test_shapiro_normal_sample_is_plausible(spark):
    random.seed(4)
    vals = [random.gauss(0, 1) for _ in range(50)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    r = st.shapiro_wilk(df, "x").first()
    assert 0.9 < r.w <= 1.0 and r.p_value > 0.01
    skew = spark.createDataFrame([(math.exp(3 * v),) for v in vals], "x double")
    assert st.shapiro_wilk(skew, "x").first().p_value < 0.001
