"""Exact top-k search by tiles of matrix products.

Vectors are packed, where they lie, into shards of ``ROWS`` rows, and the
queries into blocks of the same size. Shards and blocks are dealt to the cells
of a grid: a block goes to one row of cells and each shard to one column, so a
cell holds a bounded number of both whatever the corpus, and a shard moves
once per group of blocks. A cell multiplies each of its blocks with each of
its shards, selects the best of each tile by partial selection, and merges the
lists of its tiles; the lists of all cells are merged per query by a window
with a rank limit, which Spark applies before and after its shuffle.

Components are scaled and floored; a product is taken in doubles as long as
every score is an exact integer there, else in 64-bit integers, else in
integers of any size, whose scores are then cut to the range of a long.

Defined results: vectors that are null or hold null, NaN or infinite
components take no part (2^1016 and beyond count as infinite), nor do rows
without an id. Only vectors of equal
length are compared. A row's own id is never its result: rows that repeat the
id are left out with it. Rows that repeat other ids are candidates each, and
each query row has a list of its own. Ties go to the smaller id. Fewer
candidates than k give shorter lists; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, materialize

K = 5
SCALE = 256.0
#: Vectors of a shard or block.
ROWS = 1024
#: Blocks and shards of a cell.
CELL_BLOCKS, CELL_SHARDS = 4, 16

_PACKED = "part bigint, dim int, ids binary, cells binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs (id, vector) rows into parts of ROWS rows, by vector length."""
    waiting: dict[int, tuple[list, list, int]] = {}
    number = TaskContext.get().partitionId() << 33

    def part(dim: int, ids: list, cells: list, n: int):
        nonlocal number
        i, x = np.concatenate(ids), np.concatenate(cells).reshape(-1, dim) if dim else np.zeros((n, 0))
        while len(i):
            order = np.argsort(i[:ROWS], kind="stable")
            yield number, dim, i[:ROWS][order].tobytes(), x[:ROWS][order].tobytes()
            number += 1
            i, x = i[ROWS:], x[ROWS:]

    def rows(made: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in enumerate(types)],
                                          ["part", "dim", "ids", "cells"])

    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        vectors = batch.column(1)
        dims = np.diff(vectors.offsets.to_numpy())
        values = vectors.flatten().to_numpy(zero_copy_only=False)
        at = np.concatenate(([0], np.cumsum(dims)))
        for dim in np.unique(dims).tolist():
            own = np.flatnonzero(dims == dim)
            cells = np.floor(values[(at[own][:, None] + np.arange(dim)).ravel()])
            i, x, n = waiting.get(dim, ([], [], 0))
            waiting[dim] = (i + [ids[own]], x + [cells], n + len(own))
            if n + len(own) >= 4 * ROWS:
                yield rows(list(part(dim, *waiting.pop(dim))))
    for dim in sorted(waiting):
        yield rows(list(part(dim, *waiting[dim])))


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products of floored rows."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if most < 2.0 ** 53:
        return (q @ x.T).astype(np.int64)
    if most < 2.0 ** 62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    big = np.array([[int(v) for v in r] for r in q], object).reshape(q.shape)
    wide = np.array([[int(v) for v in r] for r in x], object).reshape(x.shape)
    got = np.array([[sum(a * b for a, b in zip(r, s, strict=True)) for s in wide] for r in big], object)
    return np.clip(got, -2 ** 63 + 1, 2 ** 63 - 1).astype(np.int64)


def best(score: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Mask of each row's k best allowed columns, ties to the earlier one."""
    least = np.iinfo(np.int64).min
    s = np.where(allowed, score, least)
    if s.shape[1] <= k:
        return allowed
    kth = np.partition(s, -k, axis=1)[:, -k][:, None]
    mask = s >= kth
    over = np.flatnonzero(mask.sum(axis=1) > k)
    if len(over):
        above = s[over] > kth[over]
        equal = s[over] == kth[over]
        room = k - above.sum(axis=1, keepdims=True)
        mask[over] = above | (equal & (np.cumsum(equal, axis=1) <= room))
    return mask & allowed


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: dict[int, tuple] = {}  # block -> its ids, and rows, candidates, scores so far
        for batch in batches:
            for block, dim, q_ids, q_cells, x_ids, x_cells in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                qi, xi = np.frombuffer(q_ids, np.int64), np.frombuffer(x_ids, np.int64)
                q = np.frombuffer(q_cells, np.float64).reshape(len(qi), dim)
                x = np.frombuffer(x_cells, np.float64).reshape(len(xi), dim)
                s = scores(q, x)
                r, c = np.nonzero(best(s, qi[:, None] != xi[None, :], k))
                found = (r, xi[c], s[r, c])
                if block in lists:
                    _, old = lists[block]
                    found = tuple(np.concatenate(p) for p in zip(old, found, strict=True))
                    order = np.lexsort((found[1], ~found[2], found[0]))  # ~x orders as -x and can't overflow
                    row = found[0][order]
                    new = np.concatenate(([True], row[1:] != row[:-1])) if len(row) else np.zeros(0, bool)
                    start = np.flatnonzero(new)
                    rank = np.arange(len(row)) - np.repeat(start, np.diff(np.concatenate((start, [len(row)]))))
                    found = tuple(p[order][rank < k] for p in found)
                lists[block] = (qi, found)
        for block, (qi, (r, ids, score)) in lists.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(r), block)), pa.array(r.astype(np.int64)), pa.array(qi[r]), pa.array(ids), pa.array(score)],
                ["block", "slot", "query_id", "vec_id", "score"])
    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: float = SCALE,
          id_col: str = "vec_id", vec_col: str = "vec") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row with ``is_query`` (an
    expression over the id) its k best others."""
    if k < 1:
        raise ValueError("k is 1 at least")
    scaled = F.transform(col(vec_col), lambda v: F.lit(scale) * v.cast("double"))
    finite = F.forall("v", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    x = vectors.where(col(id_col).isNotNull() & col(vec_col).isNotNull()) \
               .select(col(id_col).cast("bigint").alias("vec_id"), scaled.alias("v"), is_query.alias("q")).where(finite)
    shards = materialize(x.select("vec_id", "v").mapInArrow(_pack, _PACKED), "shards")
    blocks = materialize(x.where("q").select("vec_id", "v").mapInArrow(_pack, _PACKED), "blocks")
    rows, columns = -(-blocks.count() // CELL_BLOCKS) or 1, -(-shards.count() // CELL_SHARDS) or 1
    cell = lambda n: F.pmod(F.xxhash64("part"), F.lit(n))
    b = blocks.select(F.col("part").alias("block"), F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"),
                      F.col("cells").alias("q_cells"), cell(rows).alias("q_row"), _each(columns).alias("q_column"))
    s = shards.select("dim", "ids", "cells", cell(columns).alias("column"), _each(rows).alias("row"))
    tiles = b.join(s, (F.col("q_row") == F.col("row")) & (F.col("q_column") == F.col("column")) & (F.col("q_dim") == F.col("dim"))) \
             .select("block", "q_dim", "q_ids", "q_cells", "ids", "cells")
    lists = tiles.mapInArrow(_search(k), "block bigint, slot bigint, query_id bigint, vec_id bigint, score bigint")
    by = Window.partitionBy("query_id", "block", "slot").orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k) \
                .select("query_id", "rank", "vec_id", "score")


def _each(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
