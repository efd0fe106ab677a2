"""Random forest (M1) over cells of binned rows.

Features are cut at their quantiles (or between their values, if those are
few) into at most ``bins`` bins. Rows of the same bins and class are alike to
every tree, so they are counted: a tree's bootstrap weight of ``n`` alike rows
is the sum of ``n`` draws from Poisson(1), one draw from Poisson(n). So the
trees' work is bounded by the cells, not by the rows.

Each tree is a group of cells, and so is each node: groups of more than
``group_cells`` are split by histograms taken in Spark, level by level; smaller
ones are grown to the end in one task each. Nodes stay a table, whatever the
forest's size, and rows are scored by joining their cells with the trees.

As in Spark's own forest: Gini impurity, the square root of the features drawn
per node, leaves where no drawn feature gains, and sibling leaves of the same
prediction merged. A null or NaN feature lies beyond every threshold.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..session import checkpoint_dir

NODES = ("tree int, id bigint, value double, cover double, feature int, threshold double, left bigint, right bigint, "
         "gain double, pred int")
#: Gains below this are rounding errors.
NO_GAIN = 1e-12


class Tree:
    """Nodes of one tree as arrays; children are positions, -1 in leaves."""

    def __init__(self, nodes: pd.DataFrame):
        g = nodes.sort_values("id")
        ids = g["id"].to_numpy()
        self.value, self.cover, self.threshold = (g[c].to_numpy(dtype=float) for c in ("value", "cover", "threshold"))
        self.feature = g["feature"].to_numpy()
        self.left, self.right = (np.where(g[c] < 0, -1, np.searchsorted(ids, g[c])) for c in ("left", "right"))

    def levels(self) -> Iterator[np.ndarray]:
        """The inner nodes of each level, from the root."""
        node = np.zeros(1, np.int64)
        while len(node := node[self.left[node] >= 0]):
            yield node
            node = np.concatenate([self.left[node], self.right[node]])

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(rows := rows[self.left[node[rows]] >= 0]):
            at = node[rows]
            node[rows] = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return node


@dataclass
class Forest:
    nodes: DataFrame
    features: list[str]
    thresholds: list[list[float]]
    num_trees: int
    #: Cells of one block of :meth:`mean_over_trees`.
    block_cells: int = 1 << 16

    def mean_over_trees(self, df: DataFrame, per_tree: Callable[[np.ndarray, Tree], np.ndarray], width: int) -> DataFrame:
        """``df`` with ``_mean``, the trees' mean of the ``width`` numbers that
        ``per_tree`` has for a row. Rows of a cell share them; a group is one
        tree and a block of cells."""
        checkpoint_dir(df.sparkSession)
        names = [f"_c{i}" for i in range(len(self.features))]
        x = df.withColumns(dict(zip(names, bin_columns(self.features, self.thresholds), strict=True)))
        cells = x.select(*names).distinct().checkpoint()
        blocks = max(1, -(-cells.count() // self.block_cells))
        asks = cells.withColumn("block", F.pmod(F.xxhash64(*names), F.lit(blocks)).cast("int")) \
                    .withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(self.num_trees - 1))))
        nodes = self.nodes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        # a cell's upper ends fall on the same side of every threshold as its rows
        ends = [np.array([*t, np.inf]) for t in self.thresholds]

        def run(asks: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
            out = asks[names]
            if asks.empty:
                return out.assign(_part=[])
            points = np.stack([e[asks[c].to_numpy()] for c, e in zip(names, ends, strict=True)], axis=1)
            return out.assign(_part=list(np.reshape(per_tree(points, Tree(nodes)), (len(asks), width))))

        schema = cells.schema.add("_part", ArrayType(DoubleType()))
        parts = asks.groupBy("tree", "block").cogroup(nodes.groupBy("tree", "block")).applyInPandas(run, schema)
        mean = F.array(*[F.sum(F.col("_part")[i]) / self.num_trees for i in range(width)])
        return x.join(parts.groupBy(*names).agg(mean.alias("_mean")), names).drop(*names)

    def save(self, path: str) -> None:
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        self.nodes.sparkSession.createDataFrame([(self.features, self.thresholds, self.num_trees)],
                                                "features array<string>, thresholds array<array<double>>, num_trees int") \
            .write.mode("overwrite").parquet(f"{path}/forest")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Forest:
        kept = spark.read.parquet(f"{path}/forest").first()
        return cls(spark.read.parquet(f"{path}/nodes"), list(kept.features), [list(t) for t in kept.thresholds], kept.num_trees)

    def score(self, df: DataFrame, keep: Sequence) -> DataFrame:
        """``keep`` and ``y_score``, the mean class-1 share of the leaves."""
        x = self.mean_over_trees(df, lambda points, tree: tree.value[tree.leaf(points)], 1)
        return x.select(*keep, F.col("_mean")[0].alias("y_score"))


def bin_columns(features: Sequence[str], thresholds: Sequence[Sequence[float]]) -> list:
    """Per feature, the number of thresholds below the value."""
    above = lambda f, t: F.when(F.col(f).cast("double") <= t, 0).otherwise(1)
    return [sum((above(f, t) for t in ts), F.lit(0)).cast("int") for f, ts in zip(features, thresholds, strict=True)]


def find_thresholds(x: DataFrame, features: Sequence[str], bins: int) -> list[list[float]]:
    """Between all values of a feature that has at most ``bins``, else at
    its quantiles; at the greatest value, too, if rows lie beyond it (null, NaN)."""
    finite = lambda f: F.when(F.abs(F.col(f)) < float("inf"), F.col(f))
    cuts = [i / bins for i in range(1, bins)]
    row = x.agg(F.count("*").alias("n"), *[e for i, f in enumerate(features) for e in (F.max(finite(f)).alias(f"max{i}"), F.count(finite(f)).alias(f"of{i}"))],
                *[F.percentile_approx(finite(f), cuts, 10_000).alias(f"q{i}") for i, f in enumerate(features)],
                *[F.approx_count_distinct(finite(f), 0.02).alias(f"n{i}") for i, f in enumerate(features)]).first()
    few = [i for i in range(len(features)) if row[f"n{i}"] <= 2 * bins]   # so many values at most, give or take
    sets = x.agg(F.lit(0), *[F.sort_array(F.collect_set(finite(features[i]))).alias(f"v{i}") for i in few]).first()
    out = []
    for i in range(len(features)):
        values = sets[f"v{i}"] if i in few else None
        if values is not None and len(values) <= bins:
            out.append([(a + b) / 2 for a, b in zip(values, values[1:], strict=False)])
        else:
            out.append(sorted(set(row[f"q{i}"] or [])))
        if row[f"of{i}"] < row["n"] and row[f"max{i}"] is not None:
            out[i] = sorted({*out[i], row[f"max{i}"]})
    return out


def _gini(w: np.ndarray) -> np.ndarray:
    n = w.sum(axis=-1)
    return 1.0 - (w * w).sum(axis=-1) / np.maximum(n * n, 1e-300)


def best_splits(hists, total: np.ndarray, n_features: int, rng) -> tuple[np.ndarray, ...]:
    """(gain, feature, bin) of each node: ``hists`` gives per feature the
    weights (node, bin, class); a random subset of the features takes part."""
    nodes = len(total)
    k = math.ceil(math.sqrt(n_features))
    taken = np.argsort(rng.random((nodes, n_features)), axis=1) < k
    gain, feature, at = np.zeros(nodes), np.full(nodes, -1), np.zeros(nodes, np.int64)
    n, whole = total.sum(axis=1)[:, None], _gini(total)[:, None]
    for f, hist in enumerate(hists):
        low = hist.cumsum(axis=1)[:, :-1]
        if not low.shape[1]:
            continue
        high = total[:, None] - low
        nl, nr = low.sum(axis=2), high.sum(axis=2)
        g = np.where((nl > 0) & (nr > 0), whole - (nl * _gini(low) + nr * _gini(high)) / n, 0.0)
        b = g.argmax(axis=1)
        g = g[np.arange(nodes), b]
        better = taken[:, f] & (g > gain) & (g > NO_GAIN)
        gain, feature, at = np.where(better, g, gain), np.where(better, f, feature), np.where(better, b, at)
    return gain, feature, at


def grow(B: np.ndarray, W: np.ndarray, sizes: Sequence[int], depth: int, rng) -> dict[str, np.ndarray]:
    """The tree of the cells ``B`` (bins) with class weights ``W``, at most
    ``depth`` levels deep: arrays by node, the root first."""
    kinds, d = W.shape[1], B.shape[1]
    levels, made = [], 1
    cells, place = np.arange(len(B)), np.zeros(len(B), np.int64)
    frontier = np.zeros(1, np.int64)
    while True:
        m = len(frontier)
        sums = lambda key, size: np.stack([np.bincount(key, W[cells, c], size) for c in range(kinds)], axis=-1)
        total = sums(place, m)
        hists = (sums(place * sizes[f] + B[cells, f], m * sizes[f]).reshape(m, sizes[f], kinds) for f in range(d))
        gain, feature, at = best_splits(hists, total, d, rng) if depth else (np.zeros(m), np.full(m, -1), np.zeros(m, np.int64))
        split = feature >= 0
        left = np.full(m, -1)
        left[split] = made + 2 * np.arange(split.sum())
        levels.append({"id": frontier, "total": total, "gain": gain, "feature": feature, "bin": at, "left": left})
        if not split.any():
            break
        go = split[place]
        cells, place = cells[go], place[go]
        right = B[cells, feature[place]] > at[place]
        child = left[place] + right - made
        frontier = made + np.arange(2 * split.sum())
        made += len(frontier)
        place, depth = child, depth - 1
    t = {c: np.concatenate([x[c] for x in levels]) for c in levels[0]}
    t["pred"] = t["total"].argmax(axis=1)
    for x in reversed(levels):                 # sibling leaves of one prediction become one
        i = x["id"][x["left"] >= 0]
        a = t["left"][i]
        same = (t["left"][a] < 0) & (t["left"][a + 1] < 0) & (t["pred"][a] == t["pred"][a + 1])
        t["left"][i[same]] = t["feature"][i[same]] = -1
    keep, live = np.zeros(made, bool), np.zeros(1, np.int64)
    while len(live):
        keep[live] = True
        a = t["left"][live]
        a = a[a >= 0]
        live = np.concatenate([a, a + 1])
    number = np.cumsum(keep) - 1
    t = {c: v[keep] for c, v in t.items()}
    inner = t["left"] >= 0
    t["right"] = np.where(inner, number[np.minimum(t["left"] + 1, made - 1)], -1)
    t["left"] = np.where(inner, number[t["left"]], -1)
    return t


def fit_forest(train: DataFrame, features: Sequence[str], label: str = "label", num_trees: int = 100, max_depth: int = 20,
               seed: int = 42, bins: int = 32, group_cells: int = 1 << 18) -> Forest:
    checkpoint_dir(train.sparkSession)
    features, max_depth = list(features), min(max_depth, 30)
    d = len(features)
    x = train.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("int").alias("_y"))
    seen = x.agg(F.max("_y").alias("hi"), F.min("_y").alias("lo"), F.count(F.when(F.col("_y").isNull(), 1)).alias("nulls")).first()
    if seen.hi is None or seen.nulls or seen.lo < 0:
        raise ValueError("a forest learns from rows with labels 0, 1, ...")
    kinds = max(2, seen.hi + 1)
    thresholds = find_thresholds(x, features, bins)
    sizes = [len(t) + 1 for t in thresholds]
    bs, ws = [f"b{i}" for i in range(d)], [f"w{c}" for c in range(kinds)]
    cells = x.select("_y", *[b.alias(c) for b, c in zip(bin_columns(features, thresholds), bs, strict=True)]).groupBy(*bs).agg(
        *[F.count(F.when(F.col("_y") == c, 1)).alias(w) for c, w in enumerate(ws)]).withColumn("h", F.xxhash64(*bs)).checkpoint()

    def draw(batches):
        for pdf in batches:
            parts = []
            for at in range(0, len(pdf), 2000):
                part = pdf.iloc[at:at + 2000]
                n = part[ws].to_numpy()
                # a cell's draws depend on its bins alone, so they don't change with the partitions
                w = np.stack([np.random.Generator(np.random.Philox(key=[seed & (1 << 63) - 1, int(h) & (1 << 64) - 1]))
                              .poisson(lam, (num_trees, kinds)) for h, lam in zip(part["h"], n, strict=True)])
                row, tree = np.nonzero(w.sum(axis=2))
                got = {"tree": tree.astype(np.int32), "node": np.zeros(len(row), np.int64)}
                got |= {c: part[c].to_numpy()[row] for c in bs} | {c: w[row, tree, i].astype(float) for i, c in enumerate(ws)}
                parts.append(pd.DataFrame(got))
            yield pd.concat(parts) if parts else pd.DataFrame(columns=["tree", "node", *bs, *ws])

    schema = "tree int, node bigint, " + ", ".join(f"{b} int" for b in bs) + ", " + ", ".join(f"{w} double" for w in ws)
    n_cells = cells.count()
    rows = cells.mapInPandas(draw, schema)
    rows, top = (rows, []) if n_cells <= group_cells else _split_large(rows.checkpoint(), bs, ws, sizes, thresholds, group_cells, max_depth, seed)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        tree, node = int(pdf["tree"].iloc[0]), int(pdf["node"].iloc[0])
        pdf = pdf.sort_values(bs)
        t = grow(pdf[bs].to_numpy(), pdf[ws].to_numpy(), sizes, max_depth - ((node + 1).bit_length() - 1), np.random.default_rng([seed, tree, node]))
        return _node_rows(tree, (node << 32) + np.arange(len(t["left"])), t, (node << 32) + t["left"], (node << 32) + t["right"], thresholds)

    nodes = rows.repartition(num_trees, "tree", "node").groupBy("tree", "node").applyInPandas(one, NODES).checkpoint()
    for level in reversed(top):                # the same merging across the groups
        ends = nodes.where("left < 0").select("tree", "id", "pred")
        side = lambda s: ends.select("tree", F.col("id").alias(s), F.col("pred").alias(f"pred_{s}"))  # noqa: E731,B023
        joined = level.join(side("left"), ["tree", "left"], "left").join(side("right"), ["tree", "right"], "left") \
                      .withColumn("same", F.coalesce(F.col("pred_left") == F.col("pred_right"), F.lit(False))).checkpoint()
        gone = joined.where("same").select("tree", F.explode(F.array("left", "right")).alias("id"))
        stop = lambda c: F.when(F.col("same"), -1).otherwise(F.col(c)).alias(c)
        merged = joined.select("tree", "id", "value", "cover", stop("feature"), "threshold", stop("left"), stop("right"), "gain", "pred")
        merged = merged.select(*[F.col(f.name).cast(f.dataType) for f in nodes.schema])
        nodes = nodes.join(gone, ["tree", "id"], "left_anti").select(*nodes.columns).unionAll(merged).checkpoint()
    return Forest(nodes, features, thresholds, num_trees)


def _node_rows(tree: int, ids: np.ndarray, t: dict, left: np.ndarray, right: np.ndarray, thresholds) -> pd.DataFrame:
    cover, inner = t["total"].sum(axis=1), t["left"] >= 0
    at = [thresholds[f][b] if i else 0.0 for f, b, i in zip(t["feature"], t["bin"], inner, strict=True)]
    return pd.DataFrame({"tree": np.int32(tree), "id": ids, "value": t["total"][:, 1] / np.maximum(cover, 1e-300), "cover": cover,
                         "feature": t["feature"], "threshold": at, "left": np.where(inner, left, -1), "right": np.where(inner, right, -1),
                         "gain": t["gain"], "pred": t["pred"]})


def _split_large(rows: DataFrame, bs, ws, sizes, thresholds, group_cells: int, max_depth: int, seed: int) -> tuple[DataFrame, list[DataFrame]]:
    """Splits nodes of more than ``group_cells`` cells by histograms: the rows
    under their new nodes, and the split nodes of each level."""
    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        tree, node = int(pdf["tree"].iloc[0]), int(pdf["node"].iloc[0])
        hists = []
        for f, size in enumerate(sizes):
            hist, part = np.zeros((1, size, len(ws))), pdf[pdf["f"] == f]
            hist[0, part["bin"].to_numpy()] = part[ws].to_numpy()
            hists.append(hist)
        total = hists[0].sum(axis=1)
        gain, feature, at = best_splits(hists, total, len(sizes), np.random.default_rng([seed, tree, node, 1]))
        t = {"total": total, "gain": gain, "feature": feature, "bin": at, "left": feature, "pred": total.argmax(axis=1)}
        out = _node_rows(tree, np.array([node << 32]), t, np.array([2 * node + 1 << 32]), np.array([2 * node + 2 << 32]), thresholds)
        return out.assign(node=node, bin=at)

    levels, b = [], F.array(*[F.struct(F.lit(f).alias("f"), F.col(c).alias("bin")) for f, c in enumerate(bs)])
    for depth in range(max_depth):
        # a group of this level is still to be split; older ones are leaves or small
        large = rows.where(F.col("node") >= (1 << depth) - 1).groupBy("tree", "node").agg(F.count("*").alias("n")) \
                    .where(F.col("n") > group_cells).select("tree", "node").checkpoint()
        if large.isEmpty():
            break
        hist = rows.join(large, ["tree", "node"]).withColumn("x", F.explode(b)).groupBy("tree", "node", "x.f", "x.bin").agg(*[F.sum(w).alias(w) for w in ws])
        found = hist.groupBy("tree", "node").applyInPandas(split, NODES + ", node bigint, bin int").where("left >= 0").checkpoint()
        levels.append(found.drop("node", "bin"))
        cut = found.select("tree", "node", "feature", F.col("bin").alias("cut"))
        value = F.element_at(F.array(*bs), (F.col("feature") + 1).cast("int"))
        to = F.when(F.col("cut").isNull(), F.col("node")).otherwise(2 * F.col("node") + 1 + (value > F.col("cut")).cast("int"))
        rows = rows.join(cut, ["tree", "node"], "left").select("tree", to.alias("node"), *bs, *ws).checkpoint()
    return rows, levels
