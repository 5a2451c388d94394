"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridsift.session import Scratch


def _mark(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).head())


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with an edge to another; the component is the smallest node.

    Each step is two grouped minima and two joins on one node, so nothing is gathered per node, and the number of
    steps grows with the logarithm of the longest path. Each step is written, which cuts the lineage.
    """
    stars = scratch.kept(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).distinct(), "edges")
    mark = _mark(stars)
    while mark[0]:
        both = stars.unionByName(stars.select(F.col("y").alias("x"), F.col("x").alias("y")))
        lowest = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.where("y > x").join(lowest, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        lowest = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(lowest, "x").where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        stars = scratch.kept(small.unionByName(lowest.select("x", F.col("m").alias("y"))).distinct(), "stars")
        before, mark = mark, _mark(stars)
        if mark == before:
            break
    nodes = stars.select(F.col("x").alias("node"), F.col("y").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())
