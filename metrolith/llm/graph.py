"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrolith.llm._spark import cut


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of the edges (u, v): root is the least node reachable.

    Each round links the larger neighbours of a node to its least one, then the smaller ones; the
    edges end as stars around the roots after about log(n) rounds. Neighbours are reduced by a
    minimum and joined back, never collected, so a node may have any number of them. Loops count as
    nodes; an empty table gives no rows. Every round is cut off by a checkpoint.
    """
    edges = cut(edges.select("u", "v"))
    loops = edges.filter("u = v").select(F.col("u").alias("node")).distinct()
    e = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    before = None
    for _ in range(rounds):
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    found = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    alone = loops.join(found.select("node").union(roots.select("node")), "node", "left_anti")
    return found.unionByName(roots).unionByName(alone.select("node", F.col("node").alias("root")))
