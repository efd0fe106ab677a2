"""How far each source's word use is from its language's and from other
sources', by exact integer arithmetic on count cells.

Terms are counted per (language, source) in one pass; a language keeps the
terms of ``MIN_DOCS`` documents or more. A group's term has the frequency
``p = 1 + floor(SCALE * (count + 1) / (N + V))``; the distance of p from q is
``f = floor((p - q)^2 / q)``.

**Terms of a group against its language.** f depends on the term's counts in
the group and in the language alone, so terms that agree in both are one cell
with a multiplicity. f is evaluated per cell, cells of equal f are merged, and
the values are ranked with the sums of multiplicities before them: a value is
of use only if fewer than ``TOP`` terms come before it, and as each value has
a term, only the ``TOP`` largest values matter, which every task can cut to
before anything moves. Only terms of the cells left are looked up again and
numbered in UTF-8 order within their value.

**Sources of a language against each other.** Kept terms are dealt to blocks
of about ``BLOCK_TERMS`` by hash, sources to tiles of ``TILE``. One group
holds a block's counts for two tiles; its terms with the same counts in all of
their sources are one cell, evaluated once per pair of sources and counted by
its multiplicity. A block gives one partial sum per pair, so neither terms nor
documents are ever paired. Terms that occur in no source of either tile have
the same f and are added at the end by number.

Sums stay below 2^63: the p of a group add up to ``SCALE + V`` at most and no
q is below 1, so no sum of f exceeds about ``SCALE^2``. Counts are multiplied
as DECIMAL(38) or Python integers.

Defined results: null text, language and source are ''. Each row is a
document, repeated rows and ids included. Groups without terms have rows of
part ``pair``; with V = 0 their values are 0 and ranks go by name. A source
alone in its language has no ``pair`` rows. Ties go by the item's UTF-8 bytes.
Texts of any length are counted whole. Other columns have no influence,
whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, materialize

MIN_DOCS, SCALE, TOP = 3, 10 ** 9, 200
BLOCK_TERMS, TILE = 1 << 15, 64
#: Distinct (group, term) pairs a worker holds before it passes them on.
HELD = 300_000

#: Bytes outside terms become spaces, A-Z become a-z.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_COUNTED = ["lang", "source", "term", "c", "docs"]


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush():
        for (lang, source), (c, d) in groups.items():
            if c:
                keys = list(c)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys)), pa.array([source] * len(keys)), pa.array(keys, pa.binary()),
                     pa.array(list(c.values()), pa.int64()), pa.array([d[k] for k in keys], pa.int64())], _COUNTED)
        groups.clear()

    held = 0
    for batch in batches:
        for lang, source, text in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            c, d = groups.setdefault((lang, source), (Counter(), Counter()))
            words, before = terms(text), len(c)
            c.update(words)
            d.update(set(words))
            held += len(c) - before
        if held > HELD:
            yield from flush()
            held = 0
    yield from flush()


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``lang, source, term, c`` (occurrences in the group), ``l`` (in the
    language), ``first`` (one row of each kept term of the language)."""
    x = docs.mapInArrow(_count, "lang string, source string, term binary, c bigint, docs bigint") \
            .withColumn("term", F.col("term").cast("string"))
    # one exchange: grouping by (lang, source, term) keeps what is dealt by (lang, term)
    x = x.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("docs").alias("docs"))
    by = Window.partitionBy("lang", "term")
    x = x.select("lang", "source", "term", "c", F.sum("c").over(by).alias("l"), F.sum("docs").over(by).alias("df"),
                 (F.row_number().over(by.orderBy("source")) == 1).alias("first"))
    return x.where(F.col("df") >= min_docs).drop("df")


def groups(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """``lang, source, n`` (occurrences of kept terms), ``v`` (kept terms of
    the language), ``nl`` (its occurrences), ``at`` (number among the
    language's sources) of every group that occurs."""
    langs = counts.groupBy("lang").agg(F.sum(F.col("first").cast("bigint")).alias("v"), F.sum("c").alias("nl"))
    own = counts.groupBy("lang", "source").agg(F.sum("c").alias("n"))
    x = docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return x.select("lang", "source", zero("n"), zero("v"), zero("nl"),
                    (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("at"))


def frequency(count: str, n: str, v: str) -> Column:
    """p of a count; with neither occurrences nor terms there is none."""
    return F.expr(f"1 + (cast({count} + 1 as decimal(19, 0)) * cast({SCALE} as decimal(10, 0))) div nullif(cast({n} + {v} as decimal(20, 0)), 0)")


def distance(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def top_terms(counts: DataFrame, params: DataFrame, top: int = TOP) -> DataFrame:
    """``lang, source, item, value, rank`` of part ``term``."""
    cells = counts.groupBy("lang", "source", "c", "l").agg(F.count("*").alias("m")).join(params, ["lang", "source"]) \
        .withColumn("p", frequency("c", "n", "v")).withColumn("q", frequency("l", "nl", "v")) \
        .where("p > q").select("lang", "source", "c", "l", "m", distance("p", "q").alias("f"))
    cells = materialize(cells, "cells")
    down = Window.partitionBy("lang", "source").orderBy(F.desc("f"))
    values = cells.groupBy("lang", "source", "f").agg(F.sum("m").alias("m")) \
        .withColumn("r", F.row_number().over(down)).where(F.col("r") <= top) \
        .withColumn("before", F.coalesce(F.sum("m").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) \
        .where(F.col("before") < top).select("lang", "source", "f", "before")
    chosen = materialize(cells.join(values, ["lang", "source", "f"]).select("lang", "source", "c", "l", "f", "before"), "chosen")
    within = Window.partitionBy("lang", "source", "f").orderBy("term")
    x = counts.join(chosen, ["lang", "source", "c", "l"]).withColumn("r", F.row_number().over(within)).where(F.col("r") <= top)
    return x.select("lang", "source", F.col("term").alias("item"), F.col("f").alias("value"), (F.col("before") + F.col("r")).cast("int").alias("rank")) \
            .where(F.col("rank") <= top)


def cell_sums(counts: np.ndarray, n: list[int], v: int) -> np.ndarray:
    """Sum of f over the rows (terms) of ``counts`` for every ordered pair of
    columns (sources)."""
    size = counts.shape[1]
    cells, times = np.unique(counts, axis=0, return_counts=True)
    seen, at = np.unique(cells, return_inverse=True)
    at = at.reshape(cells.shape)
    p = np.empty(cells.shape, np.int64)
    for s in range(size):
        p[:, s] = np.array([1 + SCALE * (int(c) + 1) // (n[s] + v) for c in seen], np.int64)[at[:, s]]
    out = np.zeros((size, size), np.int64)
    for a in range(size):
        gap = p[:, a:a + 1] - p
        out[a] = times @ (gap * gap // p)
    return out


def _block_sums(table: pa.Table) -> pa.Table:
    """Partial sums of one block and two tiles. Rows without a term name the
    sources; the others hold their counts."""
    term, at, c, tile = (table[k].combine_chunks() for k in ("term", "at", "c", "tile"))
    named = term.is_null().to_numpy(zero_copy_only=False)
    sources, order = np.unique(at.to_numpy()[named], return_index=True)
    n = [int(x) for x in table["n"].combine_chunks().to_numpy()[named][order]]
    own = tile.to_numpy()[named][order]
    v = int(table["v"][0].as_py())
    rows = term.filter(pa.array(~named)).dictionary_encode()
    counts = np.zeros((len(rows.dictionary), len(sources)), np.int64)
    counts[rows.indices.to_numpy(), np.searchsorted(sources, at.to_numpy()[~named])] = c.to_numpy()[~named]
    sums = cell_sums(counts, n, v) if len(counts) else np.zeros((len(sources),) * 2, np.int64)
    a, b = np.nonzero(~np.eye(len(sources), dtype=bool))
    # two sources of one tile meet in that tile's own group only
    mixed = table["ti"][0].as_py() != table["tj"][0].as_py()
    keep = own[a] != own[b] if mixed else np.ones(len(a), bool)
    a, b = a[keep], b[keep]
    return pa.table({"lang": pa.array([table["lang"][0].as_py()] * len(a), pa.string()), "a": pa.array(sources[a], pa.int32()),
                     "b": pa.array(sources[b], pa.int32()), "value": pa.array(sums[a, b], pa.int64()),
                     "n_terms": pa.array(np.full(len(a), len(counts)), pa.int64())})


def pairs(counts: DataFrame, params: DataFrame, block_terms: int = BLOCK_TERMS, tile: int = TILE) -> DataFrame:
    """``lang, source, item, value, rank`` of part ``pair``."""
    per_lang = params.groupBy("lang").agg((F.floor(F.max("at") / tile)).cast("int").alias("last"), F.max("v").alias("v")) \
                     .withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("v") / block_terms)).cast("int"))
    src = materialize(params.join(per_lang.drop("v"), "lang").withColumn("tile", F.floor(F.col("at") / tile).cast("int")), "sources")
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.col("last")), lambda j: F.struct(F.least("tile", j).alias("ti"), F.greatest("tile", j).alias("tj"))))
    heads = src.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("g", grid) \
               .select("lang", "block", "g.ti", "g.tj", "tile", "at", F.lit(None).cast("string").alias("term"), F.lit(0).cast("bigint").alias("c"), "n", "v")
    body = counts.select("lang", "source", "term", "c").join(src, ["lang", "source"]) \
                 .withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")).withColumn("g", grid) \
                 .select("lang", "block", "g.ti", "g.tj", "tile", "at", "term", "c", "n", "v")
    sums = heads.unionAll(body).groupBy("lang", "block", "ti", "tj") \
                .applyInArrow(_block_sums, "lang string, a int, b int, value bigint, n_terms bigint")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("n_terms").alias("n_terms"))
    zero = src.withColumn("p0", frequency("0", "n", "v"))
    x = sums.join(zero.select("lang", F.col("at").alias("a"), "source", F.col("p0").alias("p"), "v"), ["lang", "a"]) \
            .join(zero.select("lang", F.col("at").alias("b"), F.col("source").alias("item"), F.col("p0").alias("q")), ["lang", "b"])
    # terms in neither source's tiles: all at the frequency of no occurrence
    rest = F.when(F.col("v") == F.col("n_terms"), F.lit(0).cast("bigint")).otherwise((F.col("v") - F.col("n_terms")) * distance("p", "q"))
    x = x.select("lang", "source", "item", (F.col("value") + rest).alias("value"))
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, block_terms: int = BLOCK_TERMS, tile: int = TILE,
          text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank``."""
    text = lambda c: F.coalesce(col(c).cast("string"), F.lit(""))
    x = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).cast("binary").alias("text"))
    counts = materialize(term_counts(x, min_docs), "term-counts")
    params = materialize(groups(x, counts), "groups")
    named = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return named(pairs(counts, params, block_terms, tile), "pair").unionAll(named(top_terms(counts, params, top), "term"))
