"""Connected components of a graph given by its edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from festa import shared


def stored(df: DataFrame) -> DataFrame:
    """``shared.stored``, never sent whole to all tasks: a pair takes few bytes in a file and many in the driver's memory."""
    return shared.stored(df).hint("merge")


def connected(edges: DataFrame) -> DataFrame:
    """node, root: for every node of the edges (a, b) the least node that a path leads to.

    Each round links every node's greater neighbours to its least one, then its lesser ones; the graph shrinks to stars
    in a number of rounds that grows with the logarithm of its longest path. Edges alone are stored between rounds.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    links, before = stored(edges.filter("a <> b").select(high.alias("a"), low.alias("b")).distinct()), None
    while True:
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("root"))
        large = stored(both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("root").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("root"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("root").alias("b")), F.struct(F.col("a"), F.col("root").alias("b")))).alias("l"))
        links, before = stored(small.select("l.*").filter("a <> b").distinct()), now
