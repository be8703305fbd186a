"""Connected components of a link table, by repeated star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionflow.operators.skew import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node in `links` (a, b), root being the smallest node it reaches.

    Large and small star steps in turn until nothing changes: every larger
    neighbour of a node is linked to the node's smallest neighbour, then every
    smaller one. The number of rounds grows with the logarithm of the longest
    chain. A node's smallest neighbour comes from a grouping that combines before
    its shuffle. Each step is written to the shared folder; only a row count and
    a checksum reach the driver.
    """
    wide = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = stored(links.filter("a <> b").select(*wide).distinct(), "links")
    before, now = None, _state(edges)
    while now != before:
        edges = stored(_small_star(stored(_large_star(edges), "large-star")), "small-star")
        before, now = now, _state(edges)
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = around.groupBy("a").agg(F.min("b").alias("near")).select("a", F.least("near", "a").alias("least"))
    return around.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    moved = edges.join(least, "a").filter("b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b"))).distinct()
