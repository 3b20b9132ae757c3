"""Connected components of an edge table, as rounds of DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, component): each node of edges (a, b) and the smallest node that it can reach.

    Alternating star rounds: every edge is turned so that a node's larger neighbours, then its smaller ones, point to the
    smallest node it knows.  Rounds grow with the logarithm of the graph's diameter; a hub's neighbours are rows, never a list,
    and a node's smallest neighbour is a partial aggregate, so a large group of copies costs as many rows as it has edges.
    Each round is a table in the shared folder; the driver
    only learns whether all is done.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    for k in range(100):
        # large star: every larger neighbour of a node points to the node's smallest
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and all its smaller neighbours point to the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = scratch.save(small.union(least.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{k}")
        if k:
            scratch.drop(f"{name}-{k - 1}")
        # done when all are stars: no node with two parents, none that is parent and child
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("c"), F.lit(0).alias("p")).union(now.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("x").agg(F.sum("c").alias("c"), F.max("p").alias("p")).where("c > 1 or (c > 0 and p > 0)").isEmpty():
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
