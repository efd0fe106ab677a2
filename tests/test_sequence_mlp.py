"""The sequence perceptron's packed windows and its optimizer (M7)."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.sql import functions as F

from tidewatch.operators import models as md
from tidewatch.operators import prep

STEPS = 20


@pytest.fixture(scope="module")
def windows(spark):
    rng = np.random.default_rng(3)
    rows = [(i % 3, i, float(x), float(z), int(x + z + rng.normal() > 0)) for i, (x, z) in enumerate(rng.normal(size=(900, 2)))]
    df = spark.createDataFrame(rows, "port int, id long, x double, z double, label int")
    return prep.sequence_windows(df, "port", ["id"], ["x", "z"], "label", STEPS).coalesce(1).cache()


def unpacked(row, n):
    steps, starts = np.frombuffer(row.steps), np.frombuffer(row.starts, np.int64)
    return [steps[i:i + n].tolist() for i in starts], np.frombuffer(row.labels, np.int8).tolist()


def test_packed_windows_share_their_values(windows):
    want = [([v for s in r.seq for v in s], r.label) for r in windows.collect()]
    rows = md.pack_windows(windows, 2 * STEPS).collect()
    got = [x for r in rows for x in zip(*unpacked(r, 2 * STEPS))]
    assert got == want
    # every window but a port's first adds its last step only
    assert sum(len(r.steps) for r in rows) == 8 * 2 * (len(want) + 3 * (STEPS - 1))


def test_windows_that_do_not_overlap_are_kept_whole(spark):
    rng = np.random.default_rng(5)
    rows = [([[float(v)] for v in rng.normal(size=4)], i % 2) for i in range(20)]
    df = spark.createDataFrame(rows, "seq array<array<double>>, label int").coalesce(1)
    packed = md.pack_windows(df, 4).collect()
    got = [x for r in packed for x in unpacked(r, 4)[0]]
    assert got == [[v for s in seq for v in s] for seq, _ in rows]


def test_missing_values_are_refused(spark):
    df = spark.createDataFrame([([[1.0], [None]], 0)], "seq array<array<double>>, label int")
    with pytest.raises(Exception, match="must not be missing"):
        md.fit_sequence_mlp(df, 2, (3,))


def test_training_is_that_of_spark_ml(windows):
    flat = md.flatten_windows(windows, 2 * STEPS, ["port", "id"])
    names = [f"f{i}" for i in range(2 * STEPS)]
    plain = Pipeline(stages=[md.assemble(names), MultilayerPerceptronClassifier(layers=[2 * STEPS, 5, 2], seed=42, maxIter=12)]).fit(flat)
    model = md.fit_sequence_mlp(windows, 2 * STEPS, (5,), 42, 12)
    assert np.allclose(model.stages[-1].weights.toArray(), plain.stages[-1].weights.toArray(), atol=1e-6)
    scored = md.score(model, flat, ["id"]).join(plain.transform(flat).select("id", F.col("probability").alias("p")), "id").collect()
    assert len(scored) == windows.count() and all(abs(r.y_score - r.p[1]) < 1e-6 and r.y_pred == int(r.y_score > 0.5) for r in scored)


def test_gradient_of_two_hidden_layers():
    rng = np.random.default_rng(1)
    layers = [6, 4, 3, 2]
    w = rng.normal(size=6 * 4 + 4 + 4 * 3 + 3 + 3 * 2 + 2)
    X, y = rng.normal(size=(300, 6)), rng.integers(0, 2, 300)
    loss, grad, blocks = md.mlp_gradient(w, layers, X, y)
    assert blocks == 3
    for i in range(len(w)):
        d = np.zeros(len(w))
        d[i] = 1e-6
        slope = (md.mlp_gradient(w + d, layers, X, y)[0] - md.mlp_gradient(w - d, layers, X, y)[0]) / 2e-6
        assert abs(slope - grad[i]) < 1e-6
