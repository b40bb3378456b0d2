"""Connected components of a graph in a DataFrame, and cutting long lineages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df, computed once: checkpointed where spark.checkpoint.dir or a checkpoint folder is set, else kept by its lineage."""
    spark = df.sparkSession
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder and not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return df.checkpoint() if context._jsc.sc().getCheckpointDir().isDefined() else df.persist()


def _pulled(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the least of u and its partners; minima are partly aggregated before their shuffle."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v): root is the least node that it reaches.

    Large-star and small-star steps in turn (Kiveris et al., Connected Components in MapReduce and
    Beyond), until one changes nothing; the number of rounds grows with the logarithm of the size,
    not with how long a component is. Nodes are of any type that can be ordered.
    """
    pairs = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        large = _pulled(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _pulled(large)
        after = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        pairs.unpersist()
        pairs = after
        if state == seen:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = state
