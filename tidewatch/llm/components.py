"""Connected components by contraction, with DataFrame joins only.

Each round points every node at its smallest neighbour (or itself), follows
the pointers by doubling until each ends at a node that points at itself, and
replaces both ends of every edge by the node reached; loops and repeated edges
go. Of the nodes that still have edges at least half disappear in two rounds,
and doubling needs the logarithm of the longest path, so chains and stars take
few steps. A hub's edges are aggregated with a partial ``min`` and joined
with one row of the pointer table, which AQE may split: no task needs a whole
component. Every round's tables are written to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node that has an edge to another node;
    ``root`` is the component's smallest node. Edges with a null end, loops
    and repeated edges are ignored; an empty edge table gives no rows."""
    e = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")) \
             .where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("a < b").distinct()
    e = materialize(e, "edges")
    comp = None
    while not e.isEmpty():
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        p = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")) \
                .select("node", F.least("node", "m").alias("target"))
        p = materialize(p, "pointer")
        moved = True
        while moved:
            q = p.select(F.col("node").alias("n1"), F.col("target").alias("t1"))
            p = materialize(p.select("node", "target").join(q, F.col("target") == F.col("n1"))
                            .select("node", F.col("t1").alias("target"), (F.col("t1") != F.col("target")).alias("moved")), "pointer")
            moved = not p.where("moved").isEmpty()
        pa = p.select(F.col("node").alias("na"), F.col("target").alias("ta"))
        pb = p.select(F.col("node").alias("nb"), F.col("target").alias("tb"))
        e = materialize(e.join(pa, F.col("a") == F.col("na")).join(pb, F.col("b") == F.col("nb")).where("ta <> tb")
                        .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
        if comp is None:
            comp = p.select("node", F.col("target").alias("root"))
        else:
            comp = comp.join(pa, F.col("root") == F.col("na"), "left").select("node", F.coalesce("ta", "root").alias("root"))
        comp = materialize(comp, "components")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")) if comp is None else comp
