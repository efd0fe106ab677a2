"""Uniform shuffle into shards of exact sizes by a communication matrix.

In a uniform random order of all rows, how many rows of each input partition
fall into each shard is a random matrix whose row sums are the partitions'
sizes and whose column sums are the shards' sizes: multivariate
hypergeometric. So the matrix is drawn first, and only then rows move:

1. every input partition puts its rows into a random order (no exchange) and
   is written with partition number and position;
2. the matrix is drawn from the partitions' row counts, top down: shards'
   sizes are dealt to blocks of ``FANOUT`` partitions, each block's part to
   its own partitions, and so on; every block is a group of its own with a
   generator seeded by its place, so a lost task draws the same again;
3. the running sums along a partition's row of the matrix say which positions
   go to which shard; the rows of a shard are ordered by a hash of partition
   and position, and their numbers in that order are the slots. Numbers are
   taken within slices of the hash and shifted by the slices before, so a
   shard is never one task's work.

Shard sizes differ by one at most and are exact; slots are gapless from 0.

Hypergeometric numbers are drawn by inversion. The probabilities relative to
the mode's are products of exact ratios, which needs neither factorials nor a
bound on the population.

Defined results: null texts and empty ones are rows like any other; nulls in
any column, repeated rows and ids have no influence, since no column enters
the order. The result is fixed by the seed and the division of the input into
partitions (file splits). Texts of any length move once, as they are. Shards
beyond the number of rows stay empty; an empty table gives no rows. If the
input has a column named like an added one, the added one gets leading
underscores.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.scan import running_sum

from .common import col, fresh, materialize

SHARDS, SEED = 24, 29
#: Partitions (or blocks of them) one task draws for.
FANOUT = 1024
#: Rows of one slice of a shard, about.
SLICE_ROWS = 1 << 16
#: Probabilities below this share of the mode's are left out: of all draws of
#: a lifetime, none would fall there.
LEAST = 1e-30


def _ratios(ks: np.ndarray, good: int, bad: int, n: int) -> np.ndarray:
    """P(k + 1) / P(k)."""
    k = ks.astype(np.float64)
    return (good - k) * (n - k) / ((k + 1) * (bad - n + k + 1))


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` draws without replacement are good."""
    lo, hi = max(0, n - bad), min(good, n)
    if lo == hi:
        return lo
    mode = min(max((n + 1) * (good + 1) // (good + bad + 2), lo), hi)
    spread = max(16, int(4 * (n * good * bad * (good + bad - n) / (good + bad) ** 3) ** 0.5))

    def wing(step: int) -> np.ndarray:
        out, at, last = [], mode, 1.0
        while last > LEAST and (at < hi if step > 0 else at > lo):
            stop = min(hi, at + spread) if step > 0 else max(lo, at - spread)
            ks = np.arange(at, stop) if step > 0 else np.arange(at - 1, stop - 1, -1)
            r = _ratios(ks, good, bad, n)
            w = last * np.cumprod(r if step > 0 else 1.0 / r)
            out.append(w)
            at, last = stop, float(w[-1])
        return np.concatenate(out) if out else np.zeros(0)

    down, up = wing(-1), wing(1)
    weight = np.concatenate((down[::-1], [1.0], up))
    upto = np.cumsum(weight)
    k = int(np.searchsorted(upto, rng.random() * upto[-1], "right"))
    return mode - len(down) + min(k, len(weight) - 1)


def deal(rng: np.random.Generator, sizes: list[int], shards: list[int]) -> list[list[int]]:
    """A random matrix with row sums ``sizes`` and column sums ``shards``
    (equal totals), as a uniform order of all rows would give it."""
    left, out = list(shards), []
    for size in sizes:
        pool, want, row = sum(left), size, []
        for have in left:
            k = hypergeometric(rng, have, pool - have, want)
            row.append(k)
            pool -= have
            want -= k
        left = [h - k for h, k in zip(left, row, strict=True)]
        out.append(row)
    return out


def _deal_block(seed: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        rng = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, int(rows["level"].iat[0]), int(rows["block"].iat[0])])))
        got = deal(rng, [int(n) for n in rows["n"]], [int(n) for n in rows["shards"].iat[0]])
        return pd.DataFrame({"part": rows["part"], "counts": got})
    return run


def communication_matrix(sizes: DataFrame, shard_sizes: list[int], seed: int = SEED, fanout: int = FANOUT) -> DataFrame:
    """``part, counts`` (rows for each shard) from ``part, n``, drawn from the
    top of a tree over the partitions down to them."""
    top = sizes.agg(F.max("part").alias("p")).first()["p"]
    if top is None:
        return sizes.select("part", F.array().cast("array<bigint>").alias("counts"))
    height = 1
    while fanout ** height <= top:
        height += 1
    above = None
    for level in range(height - 1, -1, -1):
        width = fanout ** level
        node = F.floor(F.col("part") / width).cast("bigint")
        nodes = sizes.groupBy(node.alias("part")).agg(F.sum("n").alias("n")) \
                     .withColumn("block", F.floor(F.col("part") / fanout).cast("bigint")).withColumn("level", F.lit(level))
        if above is None:
            nodes = nodes.withColumn("shards", F.array(*[F.lit(n).cast("bigint") for n in shard_sizes]))
        else:
            nodes = nodes.join(above.select(F.col("part").alias("block"), F.col("counts").alias("shards")), "block")
        above = materialize(nodes.groupBy("block").applyInPandas(_deal_block(seed), "part bigint, counts array<bigint>"), "matrix")
    return above


def shuffle(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, fanout: int = FANOUT, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``docs``' columns, ``shard`` (from 0) and ``slot`` (from 0 in it)."""
    if shards < 1:
        raise ValueError("at least one shard")
    own = [f"c{i}" for i in range(len(docs.columns))]
    x = docs.select(*[col(c).alias(o) for c, o in zip(docs.columns, own, strict=True)])
    # written by tasks that commit once: the order drawn here stays what it is
    inside = (F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias("pos")
    x = x.withColumn("_draw", F.rand(seed)).sortWithinPartitions("_draw").withColumn("_at", F.monotonically_increasing_id())
    x = materialize(x.select(*own, F.shiftright("_at", 33).alias("part"), inside), "permuted")
    sizes = materialize(x.groupBy("part").agg(F.count("*").alias("n")), "sizes")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    each, more = divmod(total, shards)
    matrix = communication_matrix(sizes, [each + (s < more) for s in range(shards)], seed, fanout)
    bounds = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda s: F.aggregate(F.slice("counts", 1, s), F.lit(0).cast("bigint"), lambda a, b: a + b))
    bounds = materialize(matrix.select("part", bounds.alias("upto")), "bounds")
    slices = max(1, -(-each // slice_rows))
    placed = x.join(bounds, "part") \
        .withColumn("shard", F.size(F.filter("upto", lambda b: b <= F.col("pos")))) \
        .withColumn("order", F.xxhash64(F.lit(seed), F.lit("slot"), "part", "pos").bitwiseAND(F.lit((1 << 62) - 1))) \
        .drop("upto").withColumn("one", F.lit(1).cast("bigint"))
    cut = F.floor(F.col("order") / F.lit(-(-(1 << 62) // slices))).cast("bigint")
    done = running_sum(placed, ["shard"], ["order", "part", "pos"], "one", cut, "upto")
    names = fresh(docs, "shard", "slot")
    return done.select(*[F.col(o).alias(c) for c, o in zip(docs.columns, own, strict=True)],
                       F.col("shard").cast("int").alias(names[0]), (F.col("upto") - 1).alias(names[1]))


def with_size(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size`` (bytes of the text and 8) and ``text_crc32``; a null
    text has no bytes."""
    octets = F.coalesce(col(text_col), F.lit("")).cast("binary")
    return docs.select(col(id_col).alias("doc_id"), (F.octet_length(octets) + 8).cast("bigint").alias("size"),
                       F.crc32(octets).alias("text_crc32"))


def write_shards(placed: DataFrame, path: str, shards: int = SHARDS, shard_col: str = "shard", slot_col: str = "slot") -> None:
    """Writes one folder per shard; inside it, files hold runs of slots in
    order."""
    parts = max(shards, int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed.repartitionByRange(parts, col(shard_col), col(slot_col)).sortWithinPartitions(col(shard_col), col(slot_col)) \
          .write.partitionBy(shard_col).parquet(path)
