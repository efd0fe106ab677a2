"""SimHash near-duplicates by multi-index hashing.

Fingerprints of 64 bits are cut into two segments of 32. If two fingerprints
differ in 3 bits or fewer, they differ in at most one bit of some segment. So
every distinct fingerprint is entered under its own value of each segment and
probes the values one bit away; of a pair that differs in one bit of a
segment, the fingerprint that has a 0 there probes the other's value, so only
zero bits are flipped (17 keys a segment on average, 33 at most, whatever the
corpus). Fingerprints that meet under a key are compared whole.

Exact copies share one fingerprint and are one row from the start. Under one
key, links are emitted as a spanning forest and not as pairs: small groups
compare shifted arrays, larger ones are searched breadth-first with one
vectorised comparison per fingerprint against those not yet reached. All links
are kept; only their redundant ones are not written. Components come from
``connected_components``.

Defined results: null and empty texts have fingerprint zero and link like any
other; texts with fewer words than a shingle are one shingle, and very long ones
are hashed whole, ``CHUNK`` shingles at a time. Columns of any name are kept or
have no influence. Every input row gives one output row, so repeated rows
repeat. ``component_id`` is the smallest
non-null id; rows without an id don't name a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, materialize
from .components import connected_components

SHINGLE, MAX_BITS, SEED = 3, 3, 42
SEGMENTS, SEGMENT_BITS = 2, 32
#: Shingles hashed at a time, to bound memory on very long texts.
CHUNK = 1 << 16
#: Groups up to this size compare all pairs; larger ones are searched.
SMALL_GROUP = 32

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)[:, ::-1].astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of one text (unsigned)."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        starts, ends = [0], [len(joined)]
    else:
        stop = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(stop[:len(words) - shingle] + 1).tolist()]
        ends = stop[shingle - 1:].tolist()
    n, counts, digest = len(starts), np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        h = np.array([digest(joined[s:e], SEED) for s, e in
                      zip(starts[at:at + CHUNK], ends[at:at + CHUNK], strict=True)], np.uint64)
        octets = h.astype("<u8").view(np.uint8).reshape(-1, 8)
        for k in range(8):
            counts[8 * k:8 * k + 8] += np.bincount(octets[:, k], minlength=256) @ _BITS
    return sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist())


def _fingerprint_udf(shingle: int):
    @F.arrow_udf("bigint")
    def run(texts: pa.Array) -> pa.Array:
        got = np.array([fingerprint(t.as_py(), shingle) for t in texts], np.uint64)
        return pa.array(got.view(np.int64))
    return run


def segment_keys(fp: str = "fp") -> str:
    """SQL array of the keys of a fingerprint: per segment its own value and
    the values with one zero bit set, each tagged with the segment."""
    mask = (1 << SEGMENT_BITS) - 1
    parts = []
    for s in range(SEGMENTS):
        v = f"(shiftrightunsigned({fp}, {s * SEGMENT_BITS}) & {mask}L)"
        tag = f"shiftleft({s}L, {SEGMENT_BITS})"
        parts.append(f"array({tag} | {v})")
        parts.append(f"transform(filter(sequence(0, {SEGMENT_BITS - 1}), b -> ({v} & shiftleft(1L, b)) = 0L), "
                     f"b -> {tag} | {v} | shiftleft(1L, b))")
    return f"concat({', '.join(parts)})"


def links(keys: np.ndarray, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect, under each key (sorted), all fingerprints reachable
    over differences of at most ``bits``."""
    out_a, out_b = [], []
    cut = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    size = np.diff(np.concatenate((cut, [len(keys)])))
    small = np.repeat(size <= SMALL_GROUP, size)
    for s in range(1, SMALL_GROUP):
        i = np.flatnonzero((keys[s:] == keys[:-s]) & small[s:])
        if not len(i):
            break
        near = np.bitwise_count(fps[i] ^ fps[i + s]) <= bits
        out_a.append(fps[i[near]])
        out_b.append(fps[i[near] + s])
    for at, n in zip(cut[size > SMALL_GROUP].tolist(), size[size > SMALL_GROUP].tolist(), strict=True):
        rest = np.unique(fps[at:at + n])
        while len(rest):
            root, frontier, rest = rest[0], [rest[:1]], rest[1:]
            while frontier and len(rest):
                for f in frontier.pop():
                    near = np.bitwise_count(rest ^ f) <= bits
                    if near.any():
                        found, rest = rest[near], rest[~near]
                        frontier.append(found)
                        out_a.append(np.full(len(found), root))
                        out_b.append(found)
                    if not len(rest):
                        break
    if not out_a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(out_a), np.concatenate(out_b)


def _link_batches(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        held: list[tuple[np.ndarray, np.ndarray]] = []  # batches that hold one unfinished key only

        def emit(k, f):
            a, b = links(k, f, bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False)
            f = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(k):
                continue
            held.append((k, f))
            if k[-1] == held[0][0][0]:
                continue
            keys = np.concatenate([x for x, _ in held])
            fps = np.concatenate([x for _, x in held])
            end = int(np.searchsorted(keys, keys[-1], "left"))
            yield emit(keys[:end], fps[:end])
            held = [(keys[end:], fps[end:])]
        if held:
            yield emit(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
    return run


def _grouped(docs: DataFrame, shingle: int, max_bits: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``doc_id, copy`` (hash of the text), ``fp`` per row, and ``own_fp,
    root`` per fingerprint: those of one component share a root."""
    if not 0 <= max_bits <= 2 * SEGMENTS - 1:
        raise ValueError(f"max_bits {max_bits}: the segments find up to {2 * SEGMENTS - 1}")
    fps = materialize(docs.select(col(id_col).alias("doc_id"), F.xxhash64(col(text_col)).alias("copy"),
                                  _fingerprint_udf(shingle)(col(text_col)).alias("fp")), "fp")
    own = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fp")
    keyed = own.select(F.explode(F.expr(segment_keys())).alias("key"), "fp") \
               .repartition("key").sortWithinPartitions("key")
    comp = connected_components(keyed.mapInArrow(_link_batches(max_bits), "a bigint, b bigint"))
    member = own.join(comp, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("own_fp"), F.coalesce("root", "fp").alias("root"), "first_id")
    return fps, member


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits), ``component_id`` per document."""
    fps, member = _grouped(docs, shingle, max_bits, id_col, text_col)
    top = member.groupBy(F.col("root").alias("top")).agg(F.min("first_id").alias("component_id"))
    named = member.join(top, F.col("root") == F.col("top")).select("own_fp", "component_id")
    return fps.join(named, F.col("fp") == F.col("own_fp")) \
              .select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component with all columns: the one with the
    smallest id, and among different texts under that id the one with the
    smallest hash. Rows that repeat an id belong to the components of their
    own texts; of rows that repeat both, the one with the smallest hash of its
    other columns stays. Rows without an id stay: no decision can name them."""
    fps, member = _grouped(docs, shingle, max_bits, id_col, text_col)
    best = fps.where("doc_id is not null").groupBy("fp").agg(F.min(F.struct("doc_id", "copy")).alias("best"))
    keep = best.join(member, F.col("fp") == F.col("own_fp")).groupBy("root").agg(F.min("best").alias("best")) \
               .select(F.col("best.doc_id").alias("keep_id"), F.col("best.copy").alias("keep_copy")).distinct()
    own_copy = F.xxhash64(col(text_col))
    others = [col(c) for c in docs.columns if c not in (id_col, text_col)]
    rest = F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0)
    one = docs.join(keep, (col(id_col) == F.col("keep_id")) & (own_copy == F.col("keep_copy")), "left_semi") \
        .groupBy(col(id_col).alias("keep_id"), own_copy.alias("keep_copy")) \
        .agg(F.min_by(F.struct(*[col(c) for c in docs.columns]), rest).alias("kept")) \
        .select(*[F.col("kept").getField(c).alias(c) for c in docs.columns])
    return one.unionAll(docs.where(col(id_col).isNull()))
