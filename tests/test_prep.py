"""Preparation operators: exact quantiles, scaling, splits, codes, SMOTE."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidewatch.functions.quantiles import quantiles, quantiles_long
from tidewatch.operators import prep


def test_quantiles_match_numpy_small_and_bracketed(spark):
    random.seed(3)
    vals = [float(random.choice([random.gauss(0, 1), 1.5, 1.5, 2.0])) for _ in range(3000)]
    df = spark.createDataFrame([(v, i % 3) for i, v in enumerate(vals)], "x double, g int")
    qs = [0.1, 0.25, 0.5, 0.95]
    # accuracy 50 -> groups above 100 rows use the sketch bracket path
    for acc in (100_000, 50):
        got = {(r.g, r.q): r.value for r in quantiles(df, ["x"], qs, ["g"], accuracy=acc).collect()}
        for g in range(3):
            arr = np.array([v for i, v in enumerate(vals) if i % 3 == g])
            for q in qs:
                assert abs(got[(g, q)] - np.quantile(arr, q)) < 1e-12


def test_zscore_population_and_minmax_constant(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "a double, b double")
    z, _ = prep.normalize(df, ["a", "b"], "zscore")
    a = [r.a for r in z.collect()]
    assert abs(a[0] - (1 - 7 / 3) / np.std([1, 2, 4])) < 1e-12
    assert all(r.b == 0.0 for r in z.collect())
    m, _ = prep.normalize(df, ["a", "b"], "minmax")
    assert [r.a for r in m.collect()] == [0.0, 1 / 3, 1.0] and all(r.b == 0.0 for r in m.collect())


def test_clean_dedupes_imputes_and_codes(spark):
    rows = [(1.0, "b"), (1.0, "b"), (float("inf"), None), (3.0, "a"), (None, "b")]
    df = spark.createDataFrame(rows, "x double, c string")
    out = sorted(prep.clean(df).collect(), key=lambda r: (r.x, r.c))
    # dedupe -> 4 rows; inf and NULL -> median of [1, 3] = 2; codes: a=0, b=1, missing=2
    assert [(r.x, r.c) for r in out] == [(1.0, 1), (2.0, 1), (2.0, 2), (3.0, 0)]


def test_stratified_split_exact_shares(spark, sf):
    from tidewatch.sources.views import flows
    f = flows(spark, sf).select("row_id", "label")
    s = prep.stratified_split(f, "label", "row_id", 0.15)
    c = {(r.label, r.is_test): r["count"] for r in s.groupBy("label", "is_test").count().collect()}
    for lab in (0, 1):
        n = c[(lab, True)] + c[(lab, False)]
        assert c[(lab, True)] == round(0.15 * n)


def test_exact_sample_size(spark, sf):
    from tidewatch.sources.views import flows
    assert prep.exact_sample(flows(spark, sf).select("row_id"), "row_id", 777).count() == 777


def test_stratified_pick_per_class(spark, sf):
    from tidewatch.sources.views import flows
    p = prep.stratified_pick(flows(spark, sf).select("row_id", "label"), "label", "row_id", 6, salt_buckets=4)
    assert sorted(r["count"] for r in p.groupBy("label").count().collect()) == [6, 6]


def test_smote_balances_classes(spark, sf):
    from tidewatch.operators.models import smote
    from tidewatch.sources.tables import table
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double"))
                                              .alias("vec"), "label")
    out = smote(e, "vec_id", "vec", "label", 5, 42)
    counts = [r["count"] for r in out.groupBy("label").count().collect()]
    assert len(set(counts)) == 1
    synth = out.filter("synthetic").select(F.size("vec").alias("d")).distinct().collect()
    assert [r.d for r in synth] in ([], [64])


def test_quantile_long_interpolates_like_pandas(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 2, 3, 4]], "c_name string, v double")
    got = quantiles_long(df, [0.5, 0.25])
    assert {r.q: r.value for r in got.collect()} == {0.5: 2.5, 0.25: 1.75}


def test_classes_deal_no_rows(spark):
    """Two classes must not put all rows into two tasks."""
    df = spark.range(60_000, numPartitions=6).select("id", (F.col("id") % 2).cast("int").alias("label"))
    split = prep.stratified_split(df, "label", "id", 0.15)
    sample = prep.exact_sample(df, "id", 500)
    for x in (split, sample):
        assert "SortMergeJoin" not in x._jdf.queryExecution().toString()
    assert split.rdd.getNumPartitions() == 6
    assert {r.label: r.n for r in split.where("is_test").groupBy("label").agg(F.count("*").alias("n")).collect()} == {0: 4500, 1: 4500}
    want = [r.id for r in df.withColumn("s", prep.hash_score("id")).orderBy("s").limit(500).collect()]
    assert sorted(r.id for r in sample.collect()) == sorted(want) and sample.columns == ["id", "label"]


def test_groups_deal_no_rows_to_quantiles(spark):
    df = spark.range(60_000, numPartitions=6).select((F.col("id") % 2).alias("base"), F.lit("x").alias("c_name"), (F.col("id") * 1.0).alias("v"))
    q = quantiles_long(df, [0.95], ["base"])
    assert {r.base: round(r.value, 6) for r in q.collect()} == {0: 56998.1, 1: 56999.1}
    # only tables of a row per value near the rank or per group are still joined by their keys
    plan = q._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") >= 2
