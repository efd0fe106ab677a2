"""Toxicity by FTRL-proximal logistic regression over hashed n-grams.

Features are the words of a text, its neighbouring pairs and its pairs with
one word between (skip-grams), each present or not, hashed into ``DIM``
coordinates. Every coordinate has its own learning rate, which falls with the
squared gradients it has seen, and an L1 threshold that keeps it at exactly 0
until they outgrow it. What remains is a short list of weights, small enough
to broadcast (``DIM`` pairs at the very most).

Training rows are bounded (``training_rows``). They are turned into feature
numbers where they lie, and one task learns from them in several passes, in an
order fixed by hash (averaging the weights of several learners was tried: with
rows as few as a bound allows, it found a fifth fewer toxic texts). Scoring is
one pass over all documents without a shuffle.

Defined results: null and empty texts have the bias alone. Rows are scored one
by one: repeated rows get repeated scores, a null id stays null and counts as
held out. With no usable label every score is the prior of 0.5; with labels of
one kind the bias alone is learnt. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, held_out
from .text_model import MAX_TRAINING_ROWS, WordNumbers, training_rows

BITS = 20
DIM = 1 << BITS
ALPHA, BETA, L1, L2 = 2.0, 1.0, 6.0, 0.1
PASSES = 8
#: Gradients of toxic rows count so many times: they are the rarer ones.
TOXIC_WEIGHT = 3.0
THRESHOLD = 0.7
#: Coordinate of the bias; no feature hashes to it.
BIAS = 0

_PAIR, _SKIP, _NEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_WORDS = WordNumbers()


def _coordinate(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _NEXT
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def coordinates(text: str | None) -> np.ndarray:
    """Coordinates of a text's features (repeats included, without bias)."""
    h = _WORDS.of(text)
    if not len(h):
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        parts = [_coordinate(h), _coordinate(h[:-1] * _PAIR + h[1:])]
        if len(h) > 2:
            parts.append(_coordinate(h[:-2] * _SKIP + h[2:]))
    return np.maximum(np.concatenate(parts), 1)


class Ftrl:
    """Per-coordinate FTRL-proximal for logistic loss on 0/1 features."""

    def __init__(self, dim: int = DIM, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(dim), np.zeros(dim)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where((np.abs(z) <= self.l1) & (at != BIAS), 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        """``at``: distinct coordinates, the bias among them."""
        w = self.weights(at)
        g = (probability(w.sum()) - label) * (TOXIC_WEIGHT if label else 1.0)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def probability(margin):
    return 1.0 / (1.0 + np.exp(-np.clip(margin, -35.0, 35.0)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = [np.unique(np.append(coordinates(t.as_py()), BIAS)).astype(np.int32) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(at, pa.list_(pa.int32()))], ["doc_id", "label", "at"])


def _fit_task(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["h", "doc_id"], kind="stable")
    model = Ftrl()
    for _ in range(PASSES):
        for at, label in zip(rows["at"], rows["label"], strict=True):
            model.learn(np.asarray(at, np.int64), int(label))
    used = np.flatnonzero(model.n > 0)
    w = model.weights(used)
    return pd.DataFrame({"at": used[w != 0].astype(np.int32), "w": w[w != 0]})


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_rows: int = MAX_TRAINING_ROWS,
        id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and weights that are not 0."""
    rows = training_rows(docs, labels, label_col, max_rows, id_col, text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    x = rows.mapInArrow(_features, f"doc_id {id_type}, label int, at array<int>") \
            .withColumn("h", F.xxhash64(F.lit("toxicity"), "doc_id")).withColumn("task", F.lit(0))
    # a bounded sample in one task; L1 leaves few weights, DIM at the very most
    # (sorted here: a sort in Spark samples its input, which would train twice)
    got = x.groupBy("task").applyInPandas(_fit_task, "at int, w double").toPandas().sort_values("at")
    return got["at"].to_numpy(np.int64), got["w"].to_numpy(np.float64)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        dense = np.zeros(DIM)
        dense[shared.value[0]] = shared.value[1]
        out = np.empty(len(texts))
        for i, t in enumerate(texts):
            at = coordinates(t.as_py())
            w = dense[at]
            # few features have a weight: only those need to be told apart
            hit = np.unique(at[w != 0])
            out[i] = dense[hit].sum() + dense[BIAS]
        return pa.array(probability(out))

    x = docs.select(col(id_col).alias("doc_id"), held_out(col(id_col)).alias("held_out"), run(col(text_col)).alias("score"))
    return x.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
