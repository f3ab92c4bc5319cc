"""Connected components of a table of links, without gathering them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm._spark import cut


def components(links: DataFrame) -> DataFrame:
    """node and root (the least node it reaches) of every node in ``links`` (a, b longs).

    Alternates the large-star and small-star operations: each pass joins the
    edges with the least neighbour of each node, a sum by key, so a node of any
    degree is no bottleneck.  Stops when a pass changes nothing, which takes
    about the logarithm of the number of nodes squared at worst.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())

    seen = state(edges)
    if not seen[0]:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.where("u > v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        hung = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = state(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
