"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def _settled(edges: DataFrame) -> bool:
    """Are the links stars: every node has one smaller node that has none, or has none itself?"""
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("up")).union(edges.select("v", F.lit(None)))
    per_node = ends.groupBy("node").agg(F.min("up").alias("low"), F.max("up").alias("high"), F.bool_or(F.col("up").isNull()).alias("below"))
    return per_node.where("low < high or (low is not null and below)").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links may repeat: there are never more than before, and those to a node's smallest neighbour come out once."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of the links ``u, v`` (longs); component: the smallest node.

    Each round moves all links towards smaller nodes (two joins of link-sized tables) and writes them
    as a table in the shared folder, which takes as many tasks to read as its size asks for; the one
    before goes. Links halve in length, so rounds grow with the logarithm of the longest chain. They
    end when all links are stars. An empty link table gives an empty result.
    """
    edges, at = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    for _ in range(max_rounds):
        if _settled(edges):
            break
        before = at
        edges, at = written(_small_star(_large_star(edges)))
        dropped(edges.sparkSession, before)
    else:
        raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    ).distinct()
