"""Call graphs as edge tables, and bounded searches in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.staging import stage_facts as stage


def build_edges(calls: DataFrame, defines: DataFrame) -> DataFrame:
    """(src, dst) from calls (path, symbol) and defines (path, symbol).

    A bare symbol (no dot) links only where one document defines it; one that is also defined in a precise form,
    with `(` or `#`, doesn't link by its bare name; no document links to itself.
    """
    distinct = defines.select(F.col("path").alias("dst"), "symbol").distinct()
    owners = F.count("*").over(Window.partitionBy("symbol"))
    usable = distinct.withColumn("owners", owners).filter((F.col("owners") == 1) | F.contains("symbol", F.lit(".")))
    precise = distinct.filter(F.col("symbol").rlike(r"[(#]")).select(F.regexp_extract("symbol", r"^([^(#]+)", 1).alias("symbol")).distinct()
    usable = usable.join(precise, "symbol", "left_anti")
    return calls.select(F.col("path").alias("src"), "symbol").join(usable, "symbol").filter("src <> dst").select("src", "dst").distinct()


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def distances(seeds: DataFrame, edges: DataFrame, max_hops: int) -> DataFrame:
    """(seed, path, distance): fewest hops from each seed, at most max_hops.

    One join for each hop on the frontier only: paths that a seed has reached before are left out, so cycles
    don't multiply rows. Each frontier is staged, so plans stay short; the search ends when a frontier is empty.
    """
    frontier = stage(seeds.select(F.col("path").alias("seed"), "path").distinct(), "seeds")
    seen, out = frontier, frontier.withColumn("distance", F.lit(0))
    edges = edges.select(F.col("src").alias("path"), "dst")
    for hop in range(1, max_hops + 1):
        step = frontier.join(edges, "path").select("seed", F.col("dst").alias("path")).distinct()
        frontier = stage(step.join(seen, ["seed", "path"], "left_anti"), f"hop{hop}")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        out = out.unionByName(frontier.withColumn("distance", F.lit(hop)))
    return out


def closure(edges: DataFrame, max_hops: int) -> DataFrame:
    """(seed, path) of everything that a node reaches within max_hops, itself left out."""
    nodes = edges.select(F.col("src").alias("path")).distinct()
    return distances(nodes, edges, max_hops).filter("distance > 0").select("seed", "path")
