"""Hierarchical budgeting over a domain - language - source tree (DataFrame
functions only).

A token budget is handed down the tree. At each node the budget is split among
its children by their weights, and no child gets more than its subtree can
give (tokens * ``max_epochs`` of its leaves). What a child can't take goes to
its siblings by weight; since a node's own share stays with it as long as its
subtree can take it, shortages are made up among siblings first and reach
aunts only when a whole node is exhausted. Exact by one pass over children in
order of capacity / weight (water filling).

Each leaf then takes its share as whole epochs and a token-prefix of one more:
documents in the order of md5(seed, epoch, doc_id), as long as their running
token sum stays within the rest. The end of the prefix is found digit by digit
of the hash: tokens per (leaf, next digit) are summed with map-side
aggregation, 16 rows a leaf, and the digit in which the prefix ends is followed
until ``EDGE_ROWS`` documents or fewer share it; only those are ordered row by
row. The result is the cut, the first (hash, id) that is out. The choice itself
is then a comparison with the leaf's cut in the scan of the documents; texts
aren't shuffled, and a source with a third of all rows is spread like any other.

Defined results: null domain, language or source become ``UNKNOWN``. A text's
tokens are its words; null and empty texts have none and are in every prefix
that reaches their place in the order, at no cost. Rows without an id are
never chosen. Rows that repeat an id have the same place in the order and
stand or fall together. Budgets beyond the corpus give all that the epochs
allow. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, col, fresh, materialize

UNKNOWN = "unknown"
LEVELS = ("domain", "lang", "source")
#: Documents of a leaf that are ordered row by row, at most (unless so many
#: share MAX_DIGITS hex digits of a hash: rows that repeat an id).
EDGE_ROWS, MAX_DIGITS = 64, 12
#: The plan (a row per leaf) is broadcast up to so many leaves, else joined.
MAX_BROADCAST_LEAVES = 10_000

#: Production parameters of the registered query and the pipeline.
SHARE_PERCENT = 60
SEED = 17
#: Weight of a child among its siblings; those not named have weight 1.
WEIGHTS: dict[str, dict[str, int]] = {
    "domain": {"d0": 4, "d1": 2, "d2": 1, "d3": 1},
    "lang": {"en": 4, "de": 2, "fr": 2, "es": 1},
    "source": {},
}


def source_domain(source: Column) -> Column:
    """Domain of a source: its number modulo 4 as d0 to d3, else unknown."""
    n = F.regexp_extract(source, "^src([0-9]{1,9})$", 1)
    return F.when(n != "", F.concat(F.lit("d"), (n.try_cast("int") % 4).cast("string"))).otherwise(F.lit(UNKNOWN))


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def order_key(doc_id: Column, seed: int, epoch: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), doc_id.cast("string")).cast("binary"))


def weight_of(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    w = F.lit(1)
    for name, value in weights.get(level, {}).items():
        if value <= 0:
            raise ValueError("weights are positive")
        w = F.when(F.col(level) == name, F.lit(value)).otherwise(w)
    return w.cast("double")


def fill(children: DataFrame, parents: list[str], level: str) -> DataFrame:
    """Splits ``budget`` (the parent's, on every child) by ``weight`` under
    ``cap``: adds ``share``.

    Children in order of cap / weight: one is exhausted if, with all before
    it exhausted, its part of what remains is at least its cap."""
    by = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(1))
    before = by.orderBy(F.col("cap") / F.col("weight"), level).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    x = children.withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), zero)) \
                .withColumn("parts", F.sum("weight").over(by) - F.coalesce(F.sum("weight").over(before), zero))
    x = x.withColumn("full", F.col("left") * F.col("weight") >= F.col("cap") * F.col("parts"))
    rest = x.withColumn("spent", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(zero)).over(by)) \
            .withColumn("open", F.sum(F.when(F.col("full"), zero).otherwise(F.col("weight"))).over(by))
    share = F.when(F.col("full"), F.col("cap")).otherwise((F.col("budget") - F.col("spent")) * F.col("weight") / F.col("open"))
    return rest.withColumn("share", share).drop("left", "parts", "full", "spent", "open")


def leaf_budgets(leaves: DataFrame, budget: Column, max_epochs: int, weights: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """``domain, lang, source, tokens, share`` from ``domain, lang, source,
    tokens``; ``budget`` may refer to ``total``, the corpus's tokens."""
    parents: list[str] = []
    above = None
    for level in LEVELS:
        path = [*parents, level]
        kids = leaves.groupBy(*path).agg(F.sum("tokens").alias("n")) \
                     .withColumn("cap", (F.col("n") * max_epochs).cast("double")) \
                     .withColumn("weight", weight_of(level, weights))
        if above is None:
            kids = kids.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(1)))) \
                       .withColumn("budget", budget.cast("double"))
        else:
            kids = kids.join(above.select(*parents, F.col("share").alias("budget")), parents)
        above = fill(kids, parents, level).select(*path, "n", "share")
        parents = path
    return above.select(*LEVELS, F.col("n").alias("tokens"), F.floor("share").alias("share"))


def plan(docs: DataFrame, budget: Column, seed: int, max_epochs: int,
         weights: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """A row per leaf: ``domain, lang, source, tokens, share, epochs`` (whole
    ones) and the cut ``cut_hash, cut_id`` of the epoch after them. ``docs``
    has ``domain, lang, source, doc_id, tokens``."""
    leaves = materialize(docs.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), "leaves")
    shares = leaf_budgets(leaves, budget, max_epochs, weights) \
        .withColumn("epochs", F.when(F.col("tokens") > 0, F.floor(F.col("share") / F.col("tokens"))).otherwise(F.lit(max_epochs))) \
        .withColumn("rest", F.col("share") - F.col("epochs") * F.col("tokens"))
    shares = materialize(shares, "shares")
    keyed = with_plan(docs, shares.select(*LEVELS, "epochs")).withColumn("hash", order_key(F.col("doc_id"), seed, F.col("epochs")))
    # digit by digit: of the 16 continuations of a leaf's prefix, the first whose tokens don't all fit holds the cut
    edge = shares.where("rest < tokens").select(*LEVELS, F.lit("").alias("prefix"), F.col("rest").alias("room"))
    up_to = Window.partitionBy(*LEVELS).orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for depth in range(1, MAX_DIGITS + 1):
        sums = with_plan(keyed, edge).where(F.startswith("hash", F.col("prefix"))) \
            .groupBy(*LEVELS, "room", F.substring("hash", 1, depth).alias("digit")) \
            .agg(F.sum("tokens").alias("n"), F.count("*").alias("m"))
        run = sums.withColumn("upto", F.sum("n").over(up_to)).where("upto > room")
        first = F.min_by(F.struct("digit", (F.col("room") - F.col("upto") + F.col("n")).alias("room"), "m"), "digit")
        edge = materialize(run.groupBy(*LEVELS).agg(first.alias("e"))
                           .select(*LEVELS, F.col("e.digit").alias("prefix"), F.col("e.room").alias("room"), F.col("e.m").alias("m")), "edge")
        if edge.where(F.col("m") > EDGE_ROWS).isEmpty():
            break
    inside = with_plan(keyed, edge.drop("m")).where(F.startswith("hash", F.col("prefix")))
    order = Window.partitionBy(*LEVELS).orderBy(F.struct("hash", "doc_id")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    over = inside.withColumn("upto", F.sum("tokens").over(order)).where("upto > room")
    # the first document beyond the room; those before it in the order are in
    cut = over.groupBy(*LEVELS).agg(F.min(F.struct("hash", "doc_id")).alias("c")) \
              .select(*LEVELS, F.col("c.hash").alias("cut_hash"), F.col("c.doc_id").alias("cut_id"))
    return materialize(shares.join(cut, list(LEVELS), "left"), "plan")


def with_plan(docs: DataFrame, leaves: DataFrame) -> DataFrame:
    """Joins rows with their leaf's row: broadcast if there are few leaves
    (counted), else a join that may be split at hot leaves."""
    if leaves.limit(MAX_BROADCAST_LEAVES + 1).count() <= MAX_BROADCAST_LEAVES:
        leaves = F.broadcast(leaves)
    return docs.join(leaves, list(LEVELS))


def mix(docs: DataFrame, share_percent: int = SHARE_PERCENT, max_epochs: int = 1, seed: int = SEED,
        weights: Mapping[str, Mapping[str, int]] | None = None, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``docs``' columns and its leaf's plan with ``copies``, how often each
    row is chosen (0 to ``max_epochs``), for a budget of ``share_percent``
    hundredths of the corpus's tokens. Names of the added columns, all in a
    struct ``mix``: domain, lang, source, tokens, share, copies."""
    weights = WEIGHTS if weights is None else weights
    named = [F.coalesce(source_domain(col(source_col)), F.lit(UNKNOWN)).alias("domain"),
             F.coalesce(col(lang_col), F.lit(UNKNOWN)).alias("lang"),
             F.coalesce(col(source_col), F.lit(UNKNOWN)).alias("source")]
    narrow = materialize(docs.where(col(id_col).isNotNull())
                         .select(*named, col(id_col).alias("doc_id"), count_words(col(text_col)).alias("tokens")), "tokens")
    budget = F.floor(F.col("total") * share_percent / 100)
    leaves = plan(narrow, budget, seed, max_epochs, weights)
    (row,) = fresh(docs, "row")
    x = docs.where(col(id_col).isNotNull()).select(*named, F.struct(*[col(c) for c in docs.columns]).alias(row))
    x = with_plan(x, leaves.withColumnRenamed("tokens", "leaf_tokens"))
    doc_id = F.col(row).getField(id_col)
    key = F.struct(order_key(doc_id, seed, F.col("epochs")).alias("hash"), doc_id.alias("doc_id"))
    within = F.col("cut_hash").isNull() | (key < F.struct(F.col("cut_hash").alias("hash"), F.col("cut_id").alias("doc_id")))
    # after the last epoch nothing remains
    copies = (F.col("epochs") + F.when((F.col("epochs") < max_epochs) & within, 1).otherwise(0)).cast("bigint")
    return x.select(F.col(f"{row}.*"), F.struct("domain", "lang", "source", "leaf_tokens", "share", copies.alias("copies")).alias("mix")) \
        if "mix" not in [c.lower() for c in docs.columns] else _raise("a column named mix is the result's")


def _raise(what: str):
    raise ValueError(what)


def chosen(docs: DataFrame, share_percent: int = SHARE_PERCENT, max_epochs: int = 1, seed: int = SEED,
           weights: Mapping[str, Mapping[str, int]] | None = None, **columns: str) -> DataFrame:
    """The chosen rows with the columns of ``docs``, as often as chosen."""
    if "mix" in [c.lower() for c in docs.columns]:
        (other,) = fresh(docs, "mix")
        names = {c: other if c.lower() == "mix" else c for c in docs.columns}
        renamed = docs.select(*[col(c).alias(n) for c, n in names.items()])
        out = chosen(renamed, share_percent, max_epochs, seed, weights, **{k: names[v] for k, v in columns.items()})
        return out.select(*[col(n).alias(c) for c, n in names.items()])
    x = mix(docs, share_percent, max_epochs, seed, weights, **columns).where("mix.copies > 0")
    if max_epochs > 1:
        (k,) = fresh(x, "k")
        x = x.withColumn(k, F.explode(F.sequence(F.lit(1), F.col("mix.copies").cast("int")))).drop(k)
    return x.drop("mix")
