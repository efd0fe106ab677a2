"""What the two text classifiers share: word numbering and the training rows."""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, held_out, materialize

#: Labelled rows a classifier learns from at most: those with the smallest
#: hash of their id. The bound is a parameter of each ``fit``.
MAX_TRAINING_ROWS = 12_000
#: Distinct words a worker remembers before it starts anew.
CACHE_WORDS = 1 << 19

_EDGE = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_KINDS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZbcdefghijklmnopqrstuvwxyz123456789" + bytes(range(128, 256)),
                         b"A" * 26 + b"a" * 25 + b"0" * 9 + b"a" * 128)
_RUN = re.compile(rb"(.)\1+", re.S)


def word_shape(word: bytes) -> bytes:
    """Kinds of characters in order, each run once: ``Nicht###`` is ``Aa#``."""
    return _RUN.sub(rb"\1", word.translate(_KINDS))


def plain_hash(word: bytes) -> int:
    """64-bit hash of a word's lower-case form without punctuation at its ends
    (of the punctuation, if it is nothing else)."""
    plain = word.lower()
    return xxhash.xxh64_intdigest(plain.strip(_EDGE) or plain, 1)


def shape_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word_shape(word), 2)


class WordNumbers(dict):
    """Raw word -> ``plain_hash``, remembered."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = plain_hash(word)
        return h

    def of(self, text: str | None) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        words = (text or "").encode().split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, max_rows: int, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``doc_id, text, label`` of the rows to learn from: labelled 0 or 1, not
    held out, at most ``max_rows`` ids by hash. An id labelled both ways is
    left out; one that several documents bear counts once for each."""
    y = labels.where(col(id_col).isNotNull() & col(label_col).isin(0, 1)).where(~held_out(col(id_col))) \
              .groupBy(col(id_col).alias("label_id")).agg(F.min(col(label_col)).alias("label"), F.max(col(label_col)).alias("top")) \
              .where("label = top").select("label_id", F.col("label").cast("int").alias("label"))
    y = y.orderBy(F.xxhash64("label_id"), "label_id").limit(max_rows)
    # at most max_rows pairs of numbers: small enough to broadcast
    y = materialize(y, "training-labels")
    return docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")) \
               .join(F.broadcast(y), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "label")
