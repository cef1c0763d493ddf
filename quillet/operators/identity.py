"""Digests of whole tables as trees, so that no row or task ever holds more than a few digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Digests under one node, about, at the lowest level; above it a node has 16.
LEAVES = 256


def tree_digest(rows: DataFrame, content: Column, by: list[str] | None = None, *, depth: int | None = None) -> DataFrame:
    """(by..., rows, digest): one digest of the contents of all rows of each group, whatever their order and partitioning.

    Equal contents are counted first, so a content that very many rows share is one leaf, the digest of its digest and
    count. A digest's first hexadecimal digits are its place in the tree: a node hashes the sorted digests below it,
    level by level, and since digests are evenly spread, nodes are of like size. The number of levels comes from the
    largest group, or is given; the same contents with the same depth have the same digest. Null content counts as
    empty; a group without rows has no row, and an empty table gives none.
    """
    by = by or []
    own = F.sha2(F.coalesce(content.cast("string"), F.lit("")), 256)
    counted = rows.select(*by, own.alias("own")).groupBy(*by, "own").agg(F.count("*").alias("n"))
    if depth is None:
        most = (counted.groupBy(*by).count() if by else counted.agg(F.count("*").alias("count"))).agg(F.max("count")).first()[0] or 0
        depth = next(d for d in range(64) if most <= LEAVES * 16**d)
    now = counted.select(*by, F.col("n").alias("rows"), F.sha2(F.concat_ws(":", "own", F.col("n").cast("string")), 256).alias("digest"), F.col("own").alias("place"))
    for level in range(depth, -1, -1):
        node = F.substring("place", 1, level).alias("place") if level else F.lit("").alias("place")
        members = now.select(*by, "rows", F.struct(F.col("place").alias("p"), F.col("digest").alias("d")).alias("m"), node)
        now = members.groupBy(*by, "place").agg(F.sum("rows").alias("rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["d"]), ""), 256).alias("digest"))
    return now.select(*by, "rows", "digest")


def subjects(candidates: DataFrame, docs: DataFrame, content: Column, *, depth: int | None = None) -> DataFrame:
    """candidates (repository_id, ...) with source_digest, the digest of all documents (repository_id, ...) of their repository; null where it has none.

    One changed document changes the digest of its repository's candidates and of no others.
    """
    digests = tree_digest(docs, content, ["repository_id"], depth=depth).select(F.col("repository_id").alias("digest_of"), F.col("digest").alias("source_digest"))
    return candidates.join(digests, F.col("repository_id").eqNullSafe(F.col("digest_of")), "left").drop("digest_of")
