"""Connected components of a graph by alternating stars, entirely in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairworks.llm.common import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour. Edges may come out repeatedly."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the smallest one. Edges go from large to small."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
        least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node is either tied to one smaller node or has only larger ones tied to it."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("ties"), F.lit(0).alias("centre")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("ties"), F.lit(1).alias("centre")))
    return ends.groupBy("node").agg(F.sum("ties").alias("ties"), F.max("centre").alias("centre")).filter(
        "ties > 1 OR ties = 1 AND centre = 1").isEmpty()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label): for each node with an edge the smallest node of its component.

    `edges` has the columns a and b (long). A round makes two stars; each is one aggregation and
    one join with skew handling, no node's neighbours are put together in one place. The stored
    edges of a round are read by the next, so that a lost executor costs one round. It ends when
    all edges are stars, after about the logarithm of the longest path.
    """
    now = edges.select("a", "b").filter("a <> b")
    for _ in range(rounds):
        now = materialise(_small_star(_large_star(now)), "star-edges")
        if _settled(now):
            break
    else:
        raise RuntimeError(f"no end after {rounds} rounds")
    tied = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return tied.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
