"""The kernel SVM's passes: Spark ML's weights, without keeping mapped rows."""

import threading

import numpy as np
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tidewatch.operators import models as md
from tidewatch.operators.prep import hash_score


def ring(spark, n):
    rng = np.random.default_rng(3)
    pts = rng.normal(size=(n, 2))
    label = (np.abs(np.hypot(*pts.T) - 1.2) < 0.45) ^ (rng.random(n) < 0.05)
    rows = [(i, float(a), float(b), int(y)) for i, ((a, b), y) in enumerate(zip(pts, label, strict=True))]
    return spark.createDataFrame(rows + [(n, None, float("inf"), 1), (n + 1, 0.0, 0.0, None)], "id int, a double, b double, label int").repartition(4, "id")


def test_weights_are_those_of_spark(spark):
    df = ring(spark, 1500).checkpoint()
    learned = df.where("label is not null").where(~(hash_score("id", 42) < 0.2))
    mapped = learned.select(array_to_vector(md.fourier_features(["a", "b"], 32, 1.0)).alias("features"), F.col("label").cast("double").alias("label"))
    for steps in (1, 7):
        want = LinearSVC(regParam=1e-4, maxIter=steps, standardization=False).fit(mapped)
        got = md.KernelSvm(df, ["a", "b"], "id", components=32, gamma=1.0, max_iter=steps)
        assert np.abs(got.weights - want.coefficients.toArray()).max() < 1e-9 and abs(got.intercept - want.intercept) < 1e-9
    z = np.array([r[0] for r in learned.orderBy("id").select(md.fourier_features(["a", "b"], 32, 1.0)).collect()])
    margin = np.array([r.margin for r in got.score(learned, ["id"]).orderBy("id").collect()])
    assert np.abs(z @ got.weights + got.intercept - margin).max() < 1e-9


def test_mapped_rows_are_not_kept(spark):
    """Spark's learner keeps a kilobyte a row; here it's features and label."""
    n, most, over = 20_000, [0], threading.Event()
    df = ring(spark, n).checkpoint()
    sc = spark.sparkContext._jsc.sc()
    before = {r.id() for r in sc.getRDDStorageInfo()}

    def watch():
        while not over.wait(0.05):
            most[0] = max(most[0], sum(r.memSize() + r.diskSize() for r in sc.getRDDStorageInfo() if r.id() not in before))

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        md.KernelSvm(df, ["a", "b"], "id", gamma=1.0, max_iter=3)
    finally:
        over.set()
        watcher.join()
    assert 0 < most[0] < 100 * n
