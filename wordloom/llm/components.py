"""Connected components of a graph in tables, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.session import checkpoint


def fingerprint(edges: DataFrame) -> tuple:
    mark = F.xxhash64("wl_far", "wl_near").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(mark)).first())


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's least neighbour."""
    both = edges.unionByName(edges.select(F.col("wl_near").alias("wl_far"), F.col("wl_far").alias("wl_near")))
    least = both.groupBy("wl_far").agg(F.min("wl_near").alias("wl_least"))
    least = least.withColumn("wl_least", F.least("wl_least", "wl_far"))
    tied = both.where("wl_near > wl_far").join(least, "wl_far")
    return tied.select(F.col("wl_near").alias("wl_far"), F.col("wl_least").alias("wl_near")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them."""
    least = edges.groupBy("wl_far").agg(F.min("wl_near").alias("wl_least"))
    tied = edges.join(least, "wl_far").select("wl_far", "wl_near", "wl_least")
    ends = tied.select(F.explode(F.array("wl_far", "wl_near")).alias("wl_far"), F.col("wl_least").alias("wl_near"))
    return ends.where("wl_far <> wl_near").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component``: the least node that each node with an edge reaches, itself included.

    Edges may repeat, run either way or be loops; edges with a null end are ignored. A
    node is never gathered with its neighbours: minima are reduced in each task first, and
    joins on a busy node can be split. Each round's edges are written to the checkpoint
    folder; the number of rounds grows with the logarithm of the graph.
    """
    ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    start = ends.select(F.greatest(a, b).alias("wl_far"), F.least(a, b).alias("wl_near"))
    current = checkpoint(start.where("wl_far <> wl_near").distinct())
    before = fingerprint(current)
    while before[0]:
        current = checkpoint(small_star(large_star(current)))
        after = fingerprint(current)
        if after == before:
            break
        before = after
    stars = current.select(F.col("wl_far").alias("node"), F.col("wl_near").alias("component"))
    roots = current.select(F.col("wl_near").alias("node"), F.col("wl_near").alias("component")).distinct()
    return stars.unionByName(roots)
