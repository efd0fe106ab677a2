"""Classifiers by held-out accuracy, top-k search against brute force."""

import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import quality_model, topk, toxicity
from tidewatch.llm.text_model import word_shape

SF = "/root/testdata/sf0.01"


def auc(pos, neg):
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


def checked(rows, labels, column):
    """AUC on held-out labelled rows."""
    score = {r.doc_id: r.score for r in rows}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    held = {r.doc_id: r[column] for r in labels if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    return auc([score[d] for d, y in held.items() if y == 1], [score[d] for d, y in held.items() if y == 0])


@pytest.mark.parametrize("module,column", [(toxicity, "toxic"), (quality_model, "quality")])
def test_held_out_accuracy(spark, module, column):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = module.fit(docs, labels)
    rows = module.score(docs, model).collect()
    assert len(rows) == docs.count()
    assert checked(rows, labels.collect(), column) > 0.9
    # fixed order of learning: the same model again
    again = module.fit(docs.repartition(7), labels)
    a, b = (sorted((r.doc_id, r.score) for r in module.score(docs, m).collect()) for m in (model, again))
    assert np.allclose([s for _, s in a], [s for _, s in b], atol=1e-6)


@pytest.mark.parametrize("module,column", [(toxicity, "toxic"), (quality_model, "quality")])
def test_odd_tables(spark, module, column):
    rng = random.Random(1)
    texts = [None, "", " ", "w", "w w w", "é" * 9, "word " * 90_000] + [brute.make_text(rng, 30) + (" vile" if i % 2 else "") for i in range(40)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(9, texts[9], "s"), (None, "no id", "s")],
                                 "doc_id long, text string, score string")
    rows = [(i, i % 2) for i in range(7, 47)] + [(9, 1), (10, None), (11, 7), (None, 1), (12, 0), (12, 1)]
    labels = spark.createDataFrame([(i, y, y) for i, y in rows], "doc_id long, toxic int, quality int")
    out = module.score(docs, module.fit(docs, labels)).collect()
    assert len(out) == len(texts) + 2 and all(0 <= r.score <= 1 for r in out)
    assert [r.held_out for r in out if r.doc_id is None] == [True]
    assert len({r.score for r in out if r.doc_id == 9}) == 1
    assert all(r.predicted == (r.score >= module.THRESHOLD) for r in out)
    none = module.fit(docs, labels.limit(0))
    assert {round(r.score, 3) for r in module.score(docs, none).collect()} == {0.5}
    one = module.fit(docs, labels.withColumn(column, F.lit(1)))
    assert min(r.score for r in module.score(docs, one).collect()) > 0.5
    assert module.score(docs.limit(0), none).count() == 0
    assert module.score(docs.limit(0), module.fit(docs.limit(0), labels)).count() == 0


def test_bound_on_training_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    from tidewatch.llm.text_model import training_rows
    ids = [r.doc_id for r in training_rows(docs, labels, "toxic", 50).collect()]
    assert len(ids) == 50 and not any(zlib.crc32(str(i).encode()) % 3 == 1 for i in ids)


def test_ftrl_is_sparse():
    rng = np.random.default_rng(1)
    model = toxicity.Ftrl(dim=2000)
    for _ in range(3000):
        at = np.unique(np.concatenate(([0], rng.integers(20, 2000, 15), [3] if rng.random() < 0.3 else [])).astype(int))
        model.learn(at, int(3 in at))
    w = model.weights(np.arange(2000))
    assert w[3] > 1.5 and w[3] == w.max() and (w[1:] == 0).mean() > 0.8


def test_word_shapes():
    assert [word_shape(w) for w in (b"Nicht###", b"TOKEN!!", "Èaux,".encode(), b"a1b22", b"x")] == [b"Aa#", b"A!", b"a,", b"a0a0", b"a"]


def test_context_sums_by_hand():
    table = np.zeros((quality_model.ROWS, quality_model.VECTOR))
    words = [np.array([1, 2, 3]), np.array([2])]
    shapes = [w + quality_model.BUCKETS for w in words]
    quality_model.add_contexts(table, list(zip(words, shapes, strict=True)))
    index = quality_model.index_vectors().astype(float)
    assert (np.abs(index).sum(axis=1)[:-1] == quality_model.NONZERO).all()
    assert np.array_equal(table[1], index[2] + index[3]) and np.array_equal(table[2], index[1] + index[3])
    b = quality_model.BUCKETS
    assert np.array_equal(table[b + 3], index[b + 1] + index[b + 2]) and not table[4].any()


def test_pooling_in_chunks(monkeypatch):
    table = quality_model.unit(np.random.default_rng(1).normal(size=(quality_model.ROWS, quality_model.VECTOR))).astype(np.float32)
    text = " ".join(f"w{i % 37} w{i % 37}" for i in range(100))
    whole = quality_model.pool(text, table)
    monkeypatch.setattr(quality_model, "CHUNK", 7)
    assert np.allclose(quality_model.pool(text, table), whole) and whole[-2] == pytest.approx(100 / 199)


def plain_top_k(rows, k=5):
    ok = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if i % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in ok if j != i and len(v) == len(q))[:k]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("rows_of_tile", [topk.ROWS, 37])
def test_top_k_matches_plain_version(spark, monkeypatch, rows_of_tile):
    monkeypatch.setattr(topk, "ROWS", rows_of_tile)
    rng = random.Random(2)
    vector = lambda: [rng.gauss(0, 0.2) for _ in range(8)]
    common = vector()
    rows = [(i, common if i % 3 == 0 else vector()) for i in range(400)] + [(i, [round(rng.random(), 1) for _ in range(8)]) for i in range(400, 460)]
    rows += [(500, None), (501, [1.0] * 7 + [None]), (502, [float("nan")] * 8), (550, [float("inf")] + [0.0] * 7), (600, [-1e-20] * 8),
             (650, [1.0, 2.0]), (651, [0.5, 0.5]), (652, []), (700, []), (None, common), (7, common), (7, common), (350, vector())]
    rng.shuffle(rows)
    df = spark.createDataFrame([(v, i, "x") for i, v in rows], "vec array<double>, vec_id long, score string").repartition(5)
    out = topk.top_k(df, F.col("vec_id") % 50 == 0)
    assert sorted(tuple(r) for r in out.collect()) == plain_top_k(rows)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_is_exact_beyond_doubles(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) * 2.0 ** rng.randint(18, 20) for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, vec array<double>")
    assert sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect()) == plain_top_k(rows)
    huge = [(i, [x * 2.0 ** 20 for x in v]) for i, v in rows]
    got = topk.top_k(spark.createDataFrame(huge, "vec_id long, vec array<double>"), F.col("vec_id") % 50 == 0).collect()
    assert max(r.score for r in got) == 2 ** 63 - 1
