"""Connected components of a graph of longs, by alternating large-star and small-star rounds of grouped minima.

Nothing is gathered per node beyond a minimum, which combines within tasks; each round is written to the shared
folder. The rounds end when the edges no longer change; their number grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b) with a > b, each node's neighbours linked to the node's smallest neighbour instead."""
    if large:  # of each node, the greater neighbours
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # of each node, the smaller neighbours and itself
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = moved.unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a > b").distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): each linked node's smallest reachable node, itself included. links: columns a and b."""
    edges = scratch.keep(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    sign = F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))
    before = None
    while True:
        edges, path = scratch.write(_star(_star(edges, True), False), "stars")
        now = tuple(edges.agg(F.count("*"), sign).collect()[0])
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.unionByName(roots)
