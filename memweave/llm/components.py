"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _star(pairs: DataFrame) -> DataFrame:
    """pairs (u, v): each u with the least of itself and its v, kept beside each v."""
    least = pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return pairs.join(least, "u")


def connected_components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """edges (a, b: bigint) -> (node, component), component the least node reachable; nodes without an edge are absent.

    Each step keeps the components and at most as many edges as it got; it ends when no node has two edges
    up and no edge leads to a node that has one: every edge then leads to its component's least node.
    That takes about log squared of the longest path. Hub nodes are
    pre-aggregated and joined, never gathered. Each step's table goes when the next is written.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    e = scratch.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        up = e.select("u", F.lit(1).alias("n")).unionByName(e.select(F.col("v").alias("u"), F.lit(0).alias("n")).distinct())
        if not up.groupBy("u").agg(F.sum("n").alias("n"), F.count("*").alias("m")).where("n > 1 or (n = 1 and m > 1)").head(1):
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _star(large)
        last, e = e, scratch.cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        scratch.drop(last)
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
