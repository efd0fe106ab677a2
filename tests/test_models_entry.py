"""Models (properties) and the driver contract."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidewatch.operators import models as md


def test_tree_contributions_sum_to_probability(spark, sf):
    from tidewatch.sources.views import flows
    f = flows(spark, sf).select("row_id", "label", "quantity", "price", "discount", "tax")
    feats = ["quantity", "price", "discount", "tax"]
    model = md.fit_random_forest(f, feats, "label", num_trees=5, max_depth=4)
    c = md.tree_contributions(model, f, feats, "row_id")
    tot = c.groupBy("row_id").agg(F.sum("contribution").alias("s"))
    prob = md.score(model, f, ["row_id"])
    j = tot.join(prob, "row_id").select((F.abs(F.col("s") - F.col("y_score"))).alias("e"))
    assert j.agg(F.max("e")).first()[0] < 1e-9


def test_isolation_forest_ranks_outlier_high(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(0, 1, (600, 2)))] + [(999, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    forest = md.fit_isolation_forest(df, ["a", "b"], "id", n_trees=30, sample_size=64)
    s = {r.id: r.anomaly_score for r in md.isolation_scores(df, forest, ["a", "b"], ["id"], 64).collect()}
    assert s[999] == max(s.values()) and 0 < min(s.values()) and max(s.values()) < 1


def test_pca_full_rank_has_no_error(spark):
    rng = np.random.default_rng(1)
    rows = [(i, *map(float, v)) for i, v in enumerate(rng.normal(0, 1, (50, 3)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    e = md.pca_reconstruction_error(df, ["a", "b", "c"], 3, ["id"])
    assert e.agg(F.max("recon_error")).first()[0] < 1e-12      # ||x||^2 - ||z||^2 cancels to rounding


def test_pca_error_matches_numpy_projection(spark):
    rng = np.random.default_rng(2)
    X = rng.normal(0, 1, (80, 4)) @ np.diag([3.0, 2.0, 1.0, 0.5])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(X)], "id long, a double, b double, c double, d double")
    got = {r.id: r.recon_error for r in md.pca_reconstruction_error(df, ["a", "b", "c", "d"], 2, ["id"]).collect()}
    Xc = X - X.mean(axis=0)
    _, _, vt = np.linalg.svd(Xc, full_matrices=False)
    P = vt[:2].T
    want = ((Xc - Xc @ P @ P.T) ** 2).mean(axis=1)
    assert max(abs(got[i] - want[i]) for i in range(len(X))) < 1e-9


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 5 and rows[0].alerts >= rows[-1].alerts


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_sample_of_queries_match_duckdb(spark, sf):
    con = duckdb.connect()
    for t in ("events", "lineitem", "orders", "customer", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, sql = entry.queries(), entry.oracle_sql()
    for name in ("port_scan", "session_hijack", "auc_exact", "stratified_split", "feedback_cycles",
                 "block_intervals", "median_impute", "wilcoxon"):
        df = qs[name](spark, sf)
        cols = sorted(df.columns)
        got = sorted(tuple(str(r[c]) for c in cols) for r in df.collect())
        cur = con.execute(sql[name])
        names = [d[0] for d in cur.description]
        want = sorted(tuple(str(r[names.index(c)]) for c in cols) for r in cur.fetchall())
        assert got == want, name
