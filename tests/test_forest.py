"""The forest over cells: right splits, the same by groups of any size."""

import time

import numpy as np
from pyspark.sql import functions as F

from tidewatch.operators import forest as fo
from tidewatch.operators import models as md
from tidewatch.sources.sinks import save_model


def noisy(spark, n):
    h = lambda k, m: F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(m))
    df = spark.range(n).select("id", (h(1, 50) + 1.0).alias("a"), (h(2, 100_000) / 7).alias("b"), (h(3, 11) / 100).alias("c"), (h(4, 9) / 100).alias("d"))
    return df.withColumn("label", (h(5, 3) == 0).cast("int"))


def test_noise_of_many_rows_is_learned_in_time(spark):
    """Deep trees on labels without a rule: the nodes must not pass the driver."""
    df = noisy(spark, 60_000).checkpoint()
    start = time.time()
    model = md.fit_random_forest(df, ["a", "b", "c", "d"], num_trees=24, max_depth=20)
    sc = md.score(model, df, ["id", "label"]).agg(F.count("*").alias("n"), F.min("y_score").alias("lo"), F.max("y_score").alias("hi"),
                                                  F.avg(((F.col("y_score") > 0.5) == (F.col("label") == 1)).cast("int")).alias("hit")).first()
    assert sc.n == 60_000 and 0 <= sc.lo < sc.hi <= 1 and sc.hit > 0.7
    assert time.time() - start < 120
    imp = {r.feature: r.importance for r in md.feature_importances(model, ["a", "b", "c", "d"]).collect()}
    assert abs(sum(imp.values()) - 1) < 1e-9 and min(imp.values()) > 0


def test_large_groups_are_split_by_histograms(spark):
    df = noisy(spark, 3000).withColumn("label", ((F.col("a") > 25) != (F.col("c") > 0.05)).cast("int")).checkpoint()
    feats = ["a", "b", "c", "d"]
    hit = {}
    for cells in (1 << 18, 300):
        model = fo.fit_forest(df, feats, num_trees=10, max_depth=12, group_cells=cells)
        x = md.score(model, df, ["id", "label"]).collect()
        hit[cells] = np.mean([r.label == r.y_pred for r in x])
        sums = {r.id: r.s for r in md.tree_contributions(model, df, feats, "id").groupBy("id").agg(F.sum("contribution").alias("s")).collect()}
        assert all(abs(sums[r.id] - r.y_score) < 1e-9 for r in x)
        n = model.nodes.toPandas()
        inner = n[n.left >= 0]
        by = n.set_index(["tree", "id"])
        kids = lambda c, v: by.loc[list(zip(inner.tree, inner[c], strict=True)), v].to_numpy()
        assert np.allclose(inner.cover, kids("left", "cover") + kids("right", "cover"))
        both = (kids("left", "left") < 0) & (kids("right", "left") < 0)
        assert (kids("left", "pred") != kids("right", "pred"))[both].all()
        assert len(n) == 10 + 2 * len(inner)
    assert min(hit.values()) > 0.95


def test_nulls_and_a_constant(spark, tmp_path):
    rows = [(i, None if i % 3 == 0 else float(i % 3), 1.0, int(i % 3 == 0)) for i in range(300)] + [(300, float("nan"), 1.0, 1)]
    df = spark.createDataFrame(rows, "id long, a double, b double, label int")
    model = md.fit_random_forest(df, ["a", "b"], num_trees=20, max_depth=3)
    sc = {r.id: r.y_pred for r in md.score(model, df, ["id"]).collect()}
    assert [sc[i] for i in range(300)] == [int(i % 3 == 0) for i in range(300)] and sc[300] == 1
    save_model(model, str(tmp_path / "m"))
    again = fo.Forest.load(spark, str(tmp_path / "m" / "model"))
    assert {r.id: r.y_pred for r in md.score(again, df, ["id"]).collect()} == sc
