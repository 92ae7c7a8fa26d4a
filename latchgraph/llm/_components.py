"""Connected components by alternating large-star and small-star steps, cut by checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import cut


def components(links: DataFrame) -> DataFrame:
    """``links`` has columns x and y; gives (node, component) with the least node of each component.

    Only nodes with a link appear.  Each step aggregates to one least neighbour per node, so a node
    with very many links never gathers them.
    """
    edges = cut(links.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).filter("x != y").distinct())
    before = None
    while True:
        # large star: the larger neighbours of each node go to its least neighbour
        both = edges.union(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.filter("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        # small star: the smaller neighbours of each node, and the node, go to the least of them
        down = large.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).filter("x != y")
        least = down.groupBy("x").agg(F.min("y").alias("m"))
        pairs = down.join(least, "x")
        small = pairs.select(F.col("y").alias("x"), F.col("m").alias("y")).union(least.select("x", F.col("m").alias("y")))
        edges = cut(small.filter("x != y").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("x").alias("node"), F.col("y").alias("component")).union(edges.select(F.col("y").alias("node"), F.col("y").alias("component")).distinct())
