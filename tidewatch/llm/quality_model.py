"""Quality classifier: random-indexing word vectors, pooled, and a small network.

Random indexing gives every word a sparse random index vector (a few +1 and
-1, fixed by its hash) and adds up, over the whole corpus, the index vectors of
the words around each occurrence: one pass, no matrix to factorise. Words are
hashed to ``BUCKETS`` rows, so the table of sums has a fixed size; a second
table does the same for word shapes (``Nicht###`` has the shape ``Aa#``).
Tasks add up their own texts and only the tables are shuffled.

A document is pooled to the mean and spread of its words' vectors, the mean of
its shapes' vectors, the likeness of neighbouring words (near 1 where words
are repeated) and its length. A network of two layers, in numpy, learns from a
bounded sample of labelled rows in one task; a part of the sample that takes no
part in the learning sets the temperature that the logits are divided by, so
that scores are calibrated. The tables and the network are broadcast; both
have a fixed size.

Defined results: null and empty texts pool to zeros and get that score. Rows
are scored one by one: repeated rows get repeated scores, a null id stays null
and counts as held out. With no usable labels, or of one kind only, the score
is their share of 1 (0.5 without any). An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, held_out
from .text_model import MAX_TRAINING_ROWS, WordNumbers, plain_hash, shape_hash, training_rows

BUCKETS, SHAPE_BUCKETS = 1 << 13, 1 << 10
VECTOR, NONZERO, WINDOW = 32, 4, 2
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 128, 3e-3, 1e-4
#: Every CALIBRATE-th training row sets the temperature instead.
CALIBRATE = 5
THRESHOLD = 0.5
#: Words of one batch of sums.
CHUNK = 1 << 17

ROWS = BUCKETS + SHAPE_BUCKETS
FEATURES = 3 * VECTOR + 3


class TableRows(WordNumbers):
    """Raw word -> its table row and its shape's, in one number."""

    def __missing__(self, word: bytes) -> int:
        row = plain_hash(word) % BUCKETS * SHAPE_BUCKETS + shape_hash(word) % SHAPE_BUCKETS
        self[word] = row
        return row


_ROWS = TableRows()


@lru_cache(1)
def index_vectors() -> np.ndarray:
    """Index vector of each table row, and zeros for the gap between texts."""
    rng = np.random.default_rng(7)
    out = np.zeros((ROWS + 1, VECTOR), np.int8)
    at = rng.random((ROWS, VECTOR)).argsort(axis=1)[:, :NONZERO]
    np.put_along_axis(out[:ROWS], at, rng.choice(np.array((-1, 1), np.int8), (ROWS, NONZERO)), axis=1)
    return out


def numbers(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of a text's words and of their shapes."""
    both = _ROWS.of(text).astype(np.int64)
    return both // SHAPE_BUCKETS, both % SHAPE_BUCKETS + BUCKETS


def add_contexts(table: np.ndarray, texts: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Adds, to the row of each word, the index vectors of the words within
    WINDOW of it, and the same for shapes. Texts don't touch: between them lie
    WINDOW empty places."""
    index, gap = index_vectors(), np.full(WINDOW, ROWS)
    for k in (0, 1):
        row = np.concatenate([p for t in texts for p in (t[k], gap)]).astype(np.uint16)
        own = index[row]
        near = np.zeros(own.shape, np.int16)
        for off in range(1, WINDOW + 1):
            near[off:] += own[:-off]
            near[:-off] += own[off:]
        order = np.argsort(row, kind="stable")
        row = row[order]
        start = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        sums = np.add.reduceat(near[order], start, axis=0, dtype=np.int64)
        real = row[start] < ROWS
        table[row[start][real]] += sums[real]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, waiting, n = np.zeros((ROWS, VECTOR)), [], 0
    for b in batches:
        for t in b.column(0):
            words, shapes = numbers(t.as_py())
            for s in range(0, len(words), CHUNK):
                waiting.append((words[s:s + CHUNK], shapes[s:s + CHUNK]))
                n += len(waiting[-1][0])
                if n >= CHUNK:
                    add_contexts(table, waiting)
                    waiting, n = [], 0
    if waiting:
        add_contexts(table, waiting)
    used = np.flatnonzero(table.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *[pa.array(np.ascontiguousarray(c)) for c in table[used].T]],
                                     ["row", *[f"v{i}" for i in range(VECTOR)]])


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The table of context vectors of the whole corpus, rows of length 1. The
    sums are integers, so their order doesn't matter."""
    columns = [f"v{i}" for i in range(VECTOR)]
    parts = docs.select(col(text_col).alias("text")).mapInArrow(_sums, "row int, " + ", ".join(f"{c} double" for c in columns))
    got = parts.groupBy("row").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()  # ROWS rows at most
    table = np.zeros((ROWS, VECTOR))
    table[got["row"].to_numpy()] = got[columns].to_numpy()
    return unit(table).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=-1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def pool(text: str | None, table: np.ndarray) -> np.ndarray:
    """The features of one text."""
    words, shapes = numbers(text)
    out, n = np.zeros(FEATURES), len(words)
    if not n:
        return out
    square, like, same, last = np.zeros(VECTOR), 0.0, 0, None
    for at in range(0, n, CHUNK):
        v = table[words[at:at + CHUNK]]
        out[:VECTOR] += v.sum(axis=0, dtype=np.float64)
        square += np.einsum("ij,ij->j", v, v, dtype=np.float64)
        out[2 * VECTOR:3 * VECTOR] += table[shapes[at:at + CHUNK]].sum(axis=0, dtype=np.float64)
        if last is not None:
            v = np.concatenate((last, v))
        near = np.einsum("ij,ij->i", v[1:], v[:-1])
        like, same, last = like + float(near.sum(dtype=np.float64)), same + int((near > 0.999).sum()), v[-1:]
    out[:3 * VECTOR] /= n
    out[VECTOR:2 * VECTOR] = np.sqrt(np.maximum(square / n - out[:VECTOR] ** 2, 0.0))
    if n > 1:
        out[-3], out[-2] = like / (n - 1), same / (n - 1)
    out[-1] = np.log1p(n) / 10
    return out


def train(x: np.ndarray, y: np.ndarray, keep: np.ndarray) -> dict[str, np.ndarray]:
    """Two layers by Adam on rows with ``keep``, the temperature on the others."""
    mean, sd = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = (x - mean) / sd
    rng = np.random.default_rng(11)
    w = {"w1": rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN),
         "w2": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), "b2": np.zeros(1)}
    own, label = x[keep], y[keep]
    m, v, step = {k: 0 * a for k, a in w.items()}, {k: 0 * a for k, a in w.items()}, 0
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(len(own)), max(1, len(own) // BATCH)):
            h = np.tanh(own[at] @ w["w1"] + w["b1"])
            d = (sigmoid(h @ w["w2"] + w["b2"]) - label[at]) / len(at)
            back = np.outer(d, w["w2"]) * (1 - h * h)
            grads = {"w2": h.T @ d + DECAY * w["w2"], "b2": np.array([d.sum()]),
                     "w1": own[at].T @ back + DECAY * w["w1"], "b1": back.sum(axis=0)}
            step += 1
            for k, g in grads.items():
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                w[k] -= RATE * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    net = w | {"mean": mean, "sd": sd, "temperature": np.ones(1)}
    rest = ~keep if (~keep).any() else keep
    # targets as far from 0 and 1 as so few rows allow, so that a clean split has a finite temperature
    z, up, down = logits(net, x[rest] * sd + mean), y[rest].sum(), (1 - y[rest]).sum()
    t = np.where(y[rest] > 0, (up + 1) / (up + 2), 1 / (down + 2))
    loss = lambda s: np.mean(np.logaddexp(0, z / s) - t * z / s)
    grid = np.exp(np.linspace(np.log(0.25), np.log(8.0), 141))
    net["temperature"] = np.array([min(grid, key=loss)])
    return net


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35.0, 35.0)))


def logits(net: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    # einsum adds up each row by itself: equal rows get equal scores in any batch
    h = np.tanh(np.einsum("ij,jk->ik", (x - net["mean"]) / net["sd"], net["w1"]) + net["b1"])
    return (np.einsum("ij,j->i", h, net["w2"]) + net["b2"]) / net["temperature"]


def constant(share: float) -> dict[str, np.ndarray]:
    """A network that gives every text the score ``share``."""
    p = min(max(share, 1e-6), 1 - 1e-6)
    return {"w1": np.zeros((FEATURES, 1)), "b1": np.zeros(1), "w2": np.zeros(1), "b2": np.array([np.log(p / (1 - p))]),
            "mean": np.zeros(FEATURES), "sd": np.ones(FEATURES), "temperature": np.ones(1)}


def _train_task(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["h", "doc_id"], kind="stable")
    x, y = np.array(rows["x"].to_list()), rows["label"].to_numpy(np.float64)
    net = constant(y.mean()) if len(set(y)) < 2 else train(x, y, np.arange(len(y)) % CALIBRATE != 0)
    return pd.DataFrame({"name": list(net), "shape": [list(a.shape) for a in net.values()],
                         "cells": [a.ravel().tolist() for a in net.values()]})


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = MAX_TRAINING_ROWS,
        id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The table of word vectors and the network."""
    table = word_vectors(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("array<double>")
    def pooled(texts: pa.Array) -> pa.Array:
        return pa.array([pool(t.as_py(), shared.value) for t in texts], pa.list_(pa.float64()))

    rows = training_rows(docs, labels, label_col, max_rows, id_col, text_col) \
        .select("doc_id", "label", pooled("text").alias("x"), F.xxhash64(F.lit("quality"), "doc_id").alias("h"), F.lit(0).alias("task"))
    # max_rows rows of FEATURES numbers: a bounded sample in one task
    got = rows.groupBy("task").applyInPandas(_train_task, "name string, shape array<int>, cells array<double>").collect()
    net = {r.name: np.array(r.cells).reshape(r.shape) for r in got} or constant(0.5)
    return table, net


def score(docs: DataFrame, model: tuple[np.ndarray, dict[str, np.ndarray]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        table, net = shared.value
        x = np.array([pool(t.as_py(), table) for t in texts]).reshape(-1, FEATURES)
        return pa.array(sigmoid(logits(net, x)))

    x = docs.select(col(id_col).alias("doc_id"), held_out(col(id_col)).alias("held_out"), run(col(text_col)).alias("score"))
    return x.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
