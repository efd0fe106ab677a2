"""Vector bin packing of tokenised examples into training sequences.

An example is a vector: its tokens, one segment, and its loss-bearing tokens.
A sequence has a limit on each. Sequences are filled one after another: of the
waiting examples that fit whole, the one whose vector has the largest dot
product with the sequence's free capacity (both scaled by the limits) goes in,
ties to the earlier one. When none fits, the waiting example with the largest
dot product is cut to fill the gap, if both of its parts have at least
``MIN_PIECE`` tokens. What fills a sequence of its own is cut off first.

Texts are tokenised, packed and hashed in one pass over the input's
partitions, without a shuffle: a task keeps at most ``POOL`` waiting examples
(each shorter than a sequence) and emits each sequence when it is full. The
last sequence of a partition is cut at powers of two, which need no padding
(unless the segment or loss limits bind: then it stands as it is). A sequence
id is the partition number * 2^33 + a counter; a task that runs again after an
executor is lost makes the same ids, since a partition's rows and their order
are fixed by the files.

Tokenising looks words up: the vocabulary's normaliser and splitter never join
or merge across ASCII white space, so the ids of a text are those of its words
in order. Each worker keeps the words it has met, bounded by ``CACHE_WORDS``,
and apart from them their letters in lower case, so that a word met with
another case or punctuation isn't sent through the tokenizer again.

Defined results: a null or empty text is the end id alone. Repeated rows and
ids are packed as often as they come. A null id stays null. A very long text
makes full sequences and one rest. An empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import col

MAX_TOKENS = 4096
MAX_SEGMENTS = 256
END_ID = 2
#: Waiting examples of a task.
POOL = 2048
MIN_PIECE = 16
#: About 200 bytes each, in every Python worker, and half as many letters of words.
CACHE_WORDS = 1 << 20

SCHEMA = ("doc_id {id}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "sequence_id bigint, offset bigint, loss_tokens bigint")


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def byte_characters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the
    others for the characters from 256 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in printable]
    return {b: 256 + i for i, b in enumerate(rest)}


_BYTES = byte_characters()
#: Letters whose lower case and composition are plain, then punctuation that
#: belongs to no contraction and no special token.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?*#%&$|]*)")
_PROBES = ("The", "x", "thing.", "a,", "wow!!", "ok###", "Été", "Straße,", "mañana.", "NAÏVE|", "þÿ?")


class WordCache(dict):
    """Word -> its ids as little-endian 32-bit bytes, found when first asked.

    Most words are letters and closing punctuation: their two parts go to the
    vocabulary's model as the splitter would hand them over, which saves three
    quarters of a call's time. Whether that is so is tried on a few words when
    the vocabulary is loaded; all other words, and all words if it is not, go
    through the whole tokenizer."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.parts: dict[str, bytes] = {}  # lower-case letters or punctuation -> ids
        self.direct = all(self.plain_ids(_PLAIN.fullmatch(w)) == self.whole_ids(w) for w in _PROBES)

    def whole_ids(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def part_ids(self, part: str) -> bytes:
        out = self.parts.get(part)
        if out is None:
            plain = part if part.isascii() else part.encode().decode("latin-1").translate(_BYTES)
            out = self.parts[part] = array("I", [t.id for t in self.model.tokenize(plain)]).tobytes()
        return out

    def plain_ids(self, parts: re.Match) -> list[int]:
        return list(array("I", b"".join(self.part_ids(part) for part in (parts[1].lower(), parts[2]) if part)))

    def __missing__(self, word: bytes) -> bytes:
        if not self.direct:
            out = array("I", self.whole_ids(word.decode())).tobytes()
        elif word.isalpha():  # ASCII letters
            out = self.part_ids(word.lower().decode())
        elif parts := _PLAIN.fullmatch(text := word.decode()):
            out = self.part_ids(parts[1].lower())
            if parts[2]:
                out += self.part_ids(parts[2])
        else:
            out = array("I", self.whole_ids(text)).tobytes()
        self[word] = out
        return out

    def ids(self, text: str | None) -> bytes:
        if len(self) > CACHE_WORDS:
            self.clear()
        if len(self.parts) > CACHE_WORDS // 2:
            self.parts.clear()
        return b"".join(map(self.__getitem__, (text or "").encode().split()))


_CACHES: dict[str, WordCache] = {}


def word_cache(path: str) -> WordCache:
    if path not in _CACHES:
        _CACHES[path] = WordCache(path)
    return _CACHES[path]


class Packer:
    """Fills sequences one after another from a bounded pool of examples.

    ``put`` and ``close`` return finished sequences: lists of
    ``(example, start, length)``. An example is any object; its tokens and
    loss-bearing tokens are given to ``put`` (the first ``tokens - loss``
    tokens bear no loss, as a prompt does)."""

    def __init__(self, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS,
                 max_loss: int | None = None, cut: bool = True, pool: int = POOL):
        self.limit = np.array([max_tokens, max_segments, max_tokens if max_loss is None else max_loss], np.int64)
        if (self.limit < 1).any():
            raise ValueError("limits are 1 at least")
        self.cut, self.pool = cut, pool
        self.size = np.zeros((2 * pool, 3), np.int64)  # of waiting examples: tokens, 1, loss
        self.item: list = [None] * (2 * pool)           # (example, start)
        self.n = 0

    def _wait(self, example, start: int, tokens: int, loss: int) -> None:
        if self.n == len(self.size):
            self.size = np.concatenate([self.size, np.zeros_like(self.size)])
            self.item += [None] * len(self.item)
        self.size[self.n] = tokens, 1, loss
        self.item[self.n] = (example, start)
        self.n += 1

    def put(self, example, tokens: int, loss: int | None = None) -> list[list[tuple]]:
        loss = tokens if loss is None else loss
        if not 0 <= loss <= tokens:
            raise ValueError("loss-bearing tokens are part of the tokens")
        start, out, prompt = 0, [], tokens - loss
        top, top_loss = int(self.limit[0]), int(self.limit[2])
        whole = lambda n, m: n <= top and m <= top_loss
        while not whole(tokens - start, tokens - max(start, prompt)) or tokens - start == top:
            if not self.cut and not whole(tokens - start, tokens - max(start, prompt)):
                raise ValueError(f"an example of {tokens} tokens ({loss} bearing loss) exceeds the limits")
            end = min(start + top, tokens, max(start, prompt) + top_loss)
            out.append([(example, start, end - start)])
            start = end
            if start == tokens:
                return out
        if tokens > start or not tokens:
            self._wait(example, start, tokens - start, tokens - max(start, prompt))
        while self.n >= self.pool:
            out.append(self._fill())
        return out

    def _fill(self) -> list[tuple]:
        free, out = self.limit.copy(), []
        scale = 1.0 / self.limit ** 2
        while self.n and free[1]:
            size = self.size[:self.n]
            worth = size @ (free * scale)
            fits = (size[:, 0] <= free[0]) & (size[:, 1] <= free[1]) & (size[:, 2] <= free[2])
            if fits.any():
                k = int(np.argmax(np.where(fits, worth, -1.0)))
                example, start = self.item[k]
                out.append((example, start, int(size[k, 0])))
                free = free - size[k]
                self._drop(k)
                continue
            if not self.cut:
                break
            tokens, loss = size[:, 0], size[:, 2]
            # the most tokens of each that fit, prompt first
            part = np.minimum(np.minimum(tokens, free[0]), tokens - loss + free[2])
            able = (part >= MIN_PIECE) & (tokens - part >= MIN_PIECE)
            if not able.any():
                break
            k = int(np.argmax(np.where(able, worth, -1.0)))
            example, start = self.item[k]
            n = int(part[k])
            out.append((example, start, n))
            prompt = int(tokens[k] - loss[k])
            self.item[k] = (example, start + n)
            self.size[k] = tokens[k] - n, 1, loss[k] - max(0, n - prompt)
            break
        return out

    def _drop(self, k: int) -> None:
        self.n -= 1
        self.size[k:self.n] = self.size[k + 1:self.n + 1]
        del self.item[k]
        self.item.append(None)

    def close(self) -> list[list[tuple]]:
        out = []
        while self.n:
            out.append(self._fill())
        if out and self.cut:
            out[-1:] = powers_of_two(out[-1], int(self.limit[0]))
        return out


def powers_of_two(pieces: list[tuple], full: int) -> list[list[tuple]]:
    """Cuts a sequence into ones whose lengths are powers of two, so that none
    needs padding."""
    left = sum(n for _, _, n in pieces)
    if not left or left == full:
        return [pieces]
    out, queue = [], list(pieces)
    for bit in reversed(range(left.bit_length())):
        room, seq = left & 1 << bit, []
        while room:
            example, start, n = queue.pop(0)
            take = min(n, room)
            seq.append((example, start, take))
            room -= take
            if take < n:
                queue.insert(0, (example, start + take, n - take))
        if seq:
            out.append(seq)
    return out


def _pack_batches(path: str, max_tokens: int, max_segments: int, max_loss: int | None, schema: pa.Schema, end_id: int,
                  has_prompt: bool):
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, packer = word_cache(path), Packer(max_tokens, max_segments, max_loss)
        sequence = TaskContext.get().partitionId() << 33

        def rows(done: list[list[tuple]]) -> pa.RecordBatch:
            nonlocal sequence
            out = [[] for _ in schema]
            for pieces in done:
                offset = 0
                for (doc_id, ids, prompt), start, n in pieces:
                    values = (doc_id, start, n, zlib.crc32(ids[4 * start:4 * (start + n)]), len(ids) // 4, sequence,
                              offset, n - max(0, min(n, prompt - start)))
                    for o, v in zip(out, values, strict=True):
                        o.append(v)
                    offset += n
                sequence += 1
            return pa.RecordBatch.from_arrays([pa.array(o, f.type) for o, f in zip(out, schema, strict=True)], schema=schema)

        for batch in batches:
            prompts = batch.column(2) if has_prompt else [None] * batch.num_rows
            done = []
            for doc_id, text, prompt in zip(batch.column(0), batch.column(1), prompts, strict=True):
                ids = cache.ids(text.as_py()) + tail
                p = len(cache.ids(prompt.as_py())) // 4 if has_prompt else 0
                p = min(p, len(ids) // 4)
                done += packer.put((doc_id.as_py(), ids, p), len(ids) // 4, len(ids) // 4 - p)
            if done:
                yield rows(done)
        done = packer.close()
        if done:
            yield rows(done)
    return run


def pack(docs: DataFrame, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None,
         vocabulary: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text",
         prompt_col: str | None = None) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, loss_tokens``. ``prompt_col``, if given, holds the
    leading part of each text that bears no loss. ``vocabulary`` is a
    tokenizer file that every executor can read."""
    from pyspark.sql.pandas.types import to_arrow_schema
    columns = [col(id_col).alias("doc_id"), col(text_col).alias("text")]
    if prompt_col:
        columns.append(col(prompt_col).alias("prompt"))
    x = docs.select(*columns)
    out = SCHEMA.format(id=x.schema["doc_id"].dataType.simpleString())
    schema = to_arrow_schema(x.sparkSession.createDataFrame([], out).schema)
    run = _pack_batches(vocabulary or default_vocabulary(), max_tokens, max_segments, max_loss, schema, end_id, bool(prompt_col))
    return x.mapInArrow(run, out)
