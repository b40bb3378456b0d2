"""Connected components of a graph held in a DataFrame, by alternating large-star and small-star steps.

(Kiveris et al., Connected Components in MapReduce and Beyond.) A node's edges are never gathered
in one task: minima are aggregated before the shuffle, and the join that spreads them is one that
Spark splits when a node is a hub. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written, written_count


def _minimum(edges: DataFrame) -> DataFrame:
    """edges (u, v) with m: the smallest of u and all its neighbours in edges."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """edges (u, v of any one orderable type) -> (node, root): root is the smallest node that node reaches.

    Loops, repeated edges and both directions are allowed; edges with a null end are ignored;
    nodes without an edge to another node are not in the result. An empty table gives none.
    """
    began = written_count()
    edges = written(edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _minimum(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _minimum(large)
        edges = written(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_written(began, keep=1)
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
