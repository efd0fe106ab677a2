"""Nearest neighbours stay whole as a class grows."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_neighbours_streams import exact_neighbours

import __spark_entry__ as entry
from tidewatch.operators import models as md


def recall(spark, x, ids):
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "id long, v array<double>, c int")
    got = {}
    for r in md.knn_within_class(df, "id", "v", "c", 5).collect():
        got.setdefault(r.id, {})[r.nn_rank] = r.nn_id
    assert len(got) == len(x) and all(len(v) == 5 for v in got.values())
    hit = 0
    for i in ids:
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        hit += len(set(got[i].values()) & set(np.argsort(d)[:5].tolist()))
    return hit / 5 / len(ids)


@pytest.mark.parametrize("n", [500, 3000, 12_000])
def test_recall_holds_in_64_dimensions(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 64))
    assert recall(spark, x, range(0, n, max(1, n // 300))) == 1


def test_equal_vectors_and_close_rows_of_other_blocks(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([np.repeat(rng.normal(size=(1, 3)), 120, axis=0), rng.normal(size=(180, 3))])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "id long, v array<double>, c int")
    got = {}
    for r in md.knn_within_class(df, "id", "v", "c", 4, leaf=20, max_leaf=30).collect():
        got.setdefault(r.id, {})[r.nn_rank] = r.nn_id
    want = exact_neighbours(np.arange(300), x, 4)
    assert {i: [v[r] for r in (1, 2, 3, 4)] for i, v in got.items()} == {i: list(v) for i, v in want.items()}


def clusters(n, centres, dim=64, spread=0.05):
    rng = np.random.default_rng(n)
    at = rng.normal(size=(centres, dim))
    return at[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dim))


def test_recall_holds_in_clusters(spark):
    x = clusters(30_000, 40)
    assert recall(spark, x, range(0, 30_000, 150)) == 1


def test_pivots_rule_out_most_blocks_of_clustered_rows(spark):
    x = clusters(8_000, 30)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "a long, v array<double>, c int")
    rows = md.pivot_blocks(df, 250, 16, 42).checkpoint()
    sizes = {r.block: r["count"] for r in rows.groupBy("block").count().collect()}
    assert sum(sizes.values()) == 8_000 and max(sizes.values()) <= 2 * 250 and len(sizes) >= 16
    order, vec = {}, {}
    for r in rows.collect():
        order.setdefault(r.block, []).append(r.a)
        vec[r.a] = np.array(r.v)
    far = []
    for ids in order.values():      # the bound of the first pass: the fifth neighbour in the row's own block
        y = np.stack([vec[i] for i in ids])
        d = np.sort(np.sqrt(((y[:, None] - y[None]) ** 2).sum(-1)), axis=1)
        far += [(i, float(d[j, 5]) if len(ids) > 5 else float("inf")) for j, i in enumerate(ids)]
    near = md.near_blocks(rows, spark.createDataFrame(far, "a long, far double"), 16)
    pairs = {(r.i, r.j) for r in near.collect()}
    assert len(pairs) < 0.5 * len(sizes) * (len(sizes) - 1)
    bound = dict(far)
    home = {i: b for b, ids in order.items() for i in ids}
    for i in range(0, 8_000, 40):   # no block with a row within the bound is ruled out
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        assert all(home[j] == home[i] or (home[i], home[j]) in pairs for j in np.flatnonzero(d < bound[i]) if np.isfinite(bound[i]))


def test_rows_of_no_finite_length_take_no_part(spark):
    rows = [(1, [0.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [float("nan"), 0.0], 0), (4, [float("inf"), 0.0], 0), (5, None, 0), (None, [0.0, 0.0], 0),
            (6, [0.0, 0.0], None), (7, [9.0, 9.0], 1)]
    df = spark.createDataFrame(rows, "id long, v array<double>, c int")
    got = sorted((r.id, r.nn_rank, r.nn_id) for r in md.knn_within_class(df, "id", "v", "c").collect())
    assert got == [(1, 1, 2), (2, 1, 1)]
    assert md.knn_within_class(df.limit(0), "id", "v", "c").count() == 0


def test_registered_rows_are_donors_towards_true_neighbours(spark, sf):
    rows = entry.queries()["smote_rows"](spark, sf).collect()
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label").collect()
    vec, label = {r.vec_id: np.array(r.v) for r in e}, {r.vec_id: r.label for r in e}
    near = {}
    for c in set(label.values()):
        ids = np.array([i for i in sorted(vec) if label[i] == c])
        near |= {i: set(v) for i, v in exact_neighbours(ids, np.stack([vec[i] for i in ids]), 5).items()}
    assert rows
    for r in rows:
        assert label[r.donor_id] == r.label and r.nn_id in near[r.donor_id]
        assert np.allclose(r.vec, vec[r.donor_id] + r.u * (vec[r.nn_id] - vec[r.donor_id]))
