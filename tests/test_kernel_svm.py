"""Radial-kernel SVM: kernel approximation and calibrated probabilities."""

import numpy as np
from pyspark.sql import functions as F

from tidewatch.operators import models as md


def test_inner_products_approximate_the_kernel(spark):
    pts = np.random.default_rng(1).normal(size=(12, 3))
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "i int, a double, b double, c double")
    z = np.array([r[0] for r in df.orderBy("i").select(md.fourier_features(["a", "b", "c"], 4096, 0.4)).collect()])
    want = np.exp(-0.4 * ((pts[:, None] - pts[None]) ** 2).sum(-1))
    assert np.abs(z @ z.T - want).max() < 0.08
    odd = spark.createDataFrame([(None, float("nan"), float("inf")), (0.0, 0.0, 0.0)], "a double, b double, c double")
    assert odd.select(md.fourier_features(["a", "b", "c"], 8)).distinct().count() == 1


def test_probabilities_beat_the_linear_model_on_a_ring(spark):
    rng = np.random.default_rng(7)
    pts = rng.normal(size=(3000, 2))
    label = (np.abs(np.hypot(*pts.T) - 1.2) < 0.45) ^ (rng.random(3000) < 0.05)
    df = spark.createDataFrame([(i, float(a), float(b), int(y)) for i, ((a, b), y) in enumerate(zip(pts, label, strict=True))],
                               "id int, a double, b double, label int")
    train, test = df.where("id < 2000"), df.where("id >= 2000")
    kernel = md.KernelSvm(train, ["a", "b"], "id", gamma=1.0).score(test, ["id", "label"])
    linear = md.fit_linear_svm(train.where("id < 1600"), ["a", "b"])
    margins = lambda x: md.svm_scores(linear, x, ["id", "label"])
    flat = md.platt(margins(test), md.fit_platt(margins(train.where("id >= 1600"))))
    brier = lambda x: x.agg(F.avg((F.col("probability") - F.col("label")) ** 2)).first()[0]
    got, base = brier(kernel), brier(flat)
    assert got < 0.12 < 0.2 < base
    rows = kernel.collect()
    assert len(rows) == 1000 and all((r.probability >= 0.5) == (r.y_pred == 1) for r in rows)
    high = [r.label for r in rows if r.probability > 0.8]
    assert len(high) > 100 and np.mean(high) > 0.85
