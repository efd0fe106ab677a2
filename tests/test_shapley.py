"""Exact Shapley values against the sum over all subsets."""

import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from tidewatch.operators import explain as ex
from tidewatch.operators import models as md

FEATURES = ["a", "b", "c", "d"]


def rows(spark, n=600):
    h = lambda k: (F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(1000)) / 100.0)
    df = spark.range(n).select("id", *[h(f).alias(f) for f in FEATURES])
    return df.withColumn("label", (((F.col("a") > 5) != (F.col("b") > 3)) | (F.col("c") > 9)).cast("int"))


def known_value(tree, x, known, node=0):
    """Expected value of a tree if only the features of ``known`` are known."""
    t = tree.loc[node]
    if t["left"] < 0:
        return t["value"]
    if int(t["feature"]) in known:
        return known_value(tree, x, known, int(t["left"] if x[int(t["feature"])] <= t["threshold"] else t["right"]))
    parts = [(tree.loc[int(k), "cover"], known_value(tree, x, known, int(k))) for k in (t["left"], t["right"])]
    return sum(c * v for c, v in parts) / sum(c for c, _ in parts)


def test_values_equal_the_sum_over_subsets(spark):
    df = rows(spark)
    model = md.fit_random_forest(df, FEATURES, "label", num_trees=4, max_depth=5)
    pick = df.where("id < 9")
    got = md.shapley_contributions(model, pick, FEATURES, "id", block_rows=4).toPandas().pivot(index="id", columns="feature", values="contribution")
    nodes = md.forest_nodes(model).toPandas()
    trees = [g.set_index("id") for _, g in nodes.groupby("tree")]
    assert nodes["feature"].max() == 3
    for r in pick.collect():
        x = [r[f] for f in FEATURES]
        value = {s: np.mean([known_value(t, x, s) for t in trees]) for k in range(5) for s in map(frozenset, itertools.combinations(range(4), k))}
        assert abs(got.loc[r.id, "__base__"] - value[frozenset()]) < 1e-9
        for i, f in enumerate(FEATURES):
            want = sum(math.factorial(len(s)) * math.factorial(3 - len(s)) / 24 * (value[s | {i}] - value[s]) for s in value if i not in s)
            assert abs(got.loc[r.id, f] - want) < 1e-9
    scores = {r.id: r.y_score for r in md.score(model, pick, ["id"]).collect()}
    assert all(abs(got.loc[i].sum() - p) < 1e-9 for i, p in scores.items())


def test_leaves_in_parts_give_the_same():
    rng = np.random.default_rng(1)
    lo = rng.uniform(-2, 0, (40, 3))
    args = (rng.normal(size=(7, 3)), rng.normal(size=40), lo, lo + rng.uniform(0, 3, (40, 3)), rng.uniform(size=(40, 3)))
    assert np.allclose(md.leaf_shapley(*args), md.leaf_shapley(*args, cells=50))


def test_documents_are_nested(spark):
    c = spark.createDataFrame([(1, f"f{i}", float(i - 4), (-1) ** i * i / 10) for i in range(10)], "alert_id long, feature string, value double, importance double")
    v = spark.createDataFrame([(1, "Attack", "Benign", False, 0.12345), (2, "Benign", "Benign", True, 0.5)],
                              "alert_id long, true_text string, predicted_text string, correct boolean, probability double")
    d = ex.explanation_documents(c, v).collect()
    assert len(d) == 1 and d[0].summary == "Classified as **Benign** with a confidence of 12.35%, which is **wrong** (true label: Attack)."
    assert [f.feature for f in d[0].features] == ["f8", "f6", "f4", "f2", "f0", "f9", "f7", "f5"]
    assert len(d[0].details) == 8 and [f.feature for f in d[0].all_features] == sorted(f"f{i}" for i in range(10))
    assert d[0].probability == 0.1235


def test_documents_move_contributions_once(spark):
    """Repeated alerts, missing importances and repeated descriptions come as
    joins and windows give them; contributions pass one exchange."""
    c = spark.createDataFrame([(1, "a", 1.0, 0.5), (1, "a", 1.0, 0.5), (1, "b", -2.0, -0.25), (1, "c", 0.0, None), (2, "a", 3.0, None),
                               (None, "a", 1.0, 1.0), (3, "b", 0.3, float("nan")), (3, "a", 0.1, 0.0)],
                              "alert_id long, feature string, value double, importance double")
    v = spark.createDataFrame([(i, "Attack", "Attack", True, 0.5) for i in (1, 1, 2, 3)],
                              "alert_id long, true_text string, predicted_text string, correct boolean, probability double")
    text = spark.createDataFrame([("a", "two"), ("a", "one"), (None, "none")], "feature string, description string")
    d = ex.explanation_documents(c, v, text)
    rows = sorted(d.collect(), key=lambda r: r.alert_id)
    assert [r.alert_id for r in rows] == [1, 1, 3]
    shown = [(f.position, f.feature, f.description) for f in rows[0].features]
    assert shown[:4] == [(1, "a", "one"), (1, "a", "two"), (2, "a", "one"), (2, "a", "two")]
    assert [s[:2] for s in shown[4:]] == [(6, "b")] and len(rows[0].details) == 5
    assert [f.feature for f in rows[0].all_features] == ["a", "a", "b", "c"]
    assert [(f.position, f.feature) for f in rows[2].features] == [(1, "a"), (1, "a"), (2, "b")]
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan and plan.count("Join") == 2
    top = {(r.alert_id, r.feature, r.position) for r in ex.split_top(c).collect()}
    assert top == {(1, "a", 1), (1, "a", 2), (1, "b", 6), (None, "a", 1), (3, "a", 1), (3, "b", 2)}
