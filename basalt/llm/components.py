"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import remove_table, written


def _unfinished(edges: DataFrame) -> bool:
    """Whether some node has two smaller neighbours, or a neighbour that has a smaller one itself."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("low"), F.lit(0).alias("high")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("low"), F.lit(1).alias("high")))
    sums = ends.groupBy("node").agg(F.sum("low").alias("low"), F.max("high").alias("high"))
    return not sums.where("low > 1 OR (low = 1 AND high = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component): for each node of links (a, b) the smallest node reachable.

    Large-star and small-star steps in turn, each written to the shared folder, until every edge joins a node
    with its component's smallest. The number of rounds grows with the logarithm of a component's length.
    Nodes without links do not appear.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while _unfinished(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        nxt = written(small.where("a <> b").distinct(), "links")
        remove_table(edges)
        edges = nxt
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
