"""Mutual information by nearest neighbours against a quadratic version."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import prep


def harmonic_digamma(n):
    return sum(1 / i for i in range(1, int(n))) - 0.5772156649015329


def plain(values, labels, k=3):
    by = {c: [v for v, d in zip(values, labels, strict=True) if d == c] for c in set(labels)}
    by = {c: np.array(v) for c, v in by.items() if len(v) > 1}
    every = np.concatenate(list(by.values()))
    total = harmonic_digamma(len(every))
    for own in by.values():
        kc = min(k, len(own) - 1)
        total += len(own) / len(every) * (harmonic_digamma(kc) - harmonic_digamma(len(own)))
        for v in own:
            r = np.sort(np.maximum(own - v, v - own))[kc]
            m = ((every > v - r) & (every < v + r)).sum() if r > 0 else (every == v).sum()
            total -= harmonic_digamma(m) / len(every)
    return max(total, 0.0)


def test_digamma(spark):
    for n in (1, 2, 3, 10, 1000):
        assert spark.range(1).select(prep.digamma(F.lit(n))).first()[0] == pytest.approx(harmonic_digamma(n), abs=1e-9)


@pytest.mark.parametrize("segment_rows", [7, 1 << 16])
def test_matches_quadratic_version(spark, segment_rows):
    rng = np.random.default_rng(4)
    n = 2000 if segment_rows > 7 else 300
    labels = rng.choice(["a", "b", None], n, p=[0.7, 0.25, 0.05]).tolist()
    shift = np.array([{"a": 0.0, "b": 2.0, None: -1.0}[c] for c in labels])
    cols = {"apart": rng.normal(size=n) + shift, "noise": rng.normal(size=n), "tied": rng.integers(0, 5, n).astype(float),
            "hot": np.where(rng.random(n) < 0.9, 7.0, rng.normal(size=n)), "steps": np.round(rng.normal(size=n) + shift, 1), "flat": np.ones(n)}
    # a class of one row, a class of three, values that are left out
    labels += ["lone", "few", "few", "few", "a", "a"]
    tail = {"apart": [9.0, 1.0, 2.0, 5.0, math.nan, math.inf]}
    cols = {c: [*map(float, v), *tail.get(c, [9.0, 1.0, 2.0, 5.0, math.nan, -math.inf])] for c, v in cols.items()}
    rows = [tuple(r) for r in zip(labels, *cols.values(), strict=True)]
    df = spark.createDataFrame(rows, "label string, " + ", ".join(f"{c} double" for c in cols))
    got = {r.feature: r.mi for r in prep.neighbour_mutual_info(df, list(cols), segment_rows=segment_rows).collect()}
    assert set(got) == set(cols)
    for c, v in cols.items():
        assert got[c] == pytest.approx(plain(v[:-2], labels[:-2]), abs=1e-7), c
    assert got["apart"] > 0.2 > 0.15 > got["noise"]


def test_nothing_to_compare(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", None)], "label string, x double")
    assert prep.neighbour_mutual_info(df, ["x"]).count() == 0
    assert prep.neighbour_mutual_info(df.limit(0), ["x"]).count() == 0
