"""Connected components of an edge table, without collecting edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage

#: Links in one partition of a round, about.
EDGES_IN_PART = 200_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for edges (a, b): the smallest node that links reach. Nodes without an edge don't appear.

    Alternates the large-star and small-star steps: each replaces a node's links by links to its least
    neighbour. Only minima are grouped, so a node with very many links is summed up before any shuffle,
    and the joins on a node are plain ones that adaptive execution splits. Each round is staged; the number of rounds grows with the logarithm of the links.
    """
    now = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    # As many files as rows ask for: rounds over few links are not spread over the session's partitions.
    parts = 1 + now.count() // EDGES_IN_PART
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).select(F.col("a").alias("n"), "m")
        large = both.join(least, F.col("a") == F.col("n")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stage(large.distinct().coalesce(parts), "large")
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        small = large.join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        then = stage(small.union(low.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct().coalesce(parts), "small")
        # The stars are whole when each node points at one least neighbour, and no neighbour points on.
        ends = then.select("a", F.lit(1).alias("out"), F.lit(0).alias("in")).union(then.select("b", F.lit(0), F.lit(1)))
        done = ends.groupBy("a").agg(F.sum("out").alias("out"), F.max("in").alias("in")).filter("out > 1 or (out = 1 and in = 1)").isEmpty()
        unstage(large, now)
        now = then
        if done:
            break
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(now.select("b", "b").distinct())
