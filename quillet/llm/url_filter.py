"""URL filters: exact membership by a cascade of Bloom filters, under host and path rules.

The first level encodes the listed keys; the keys of the universe that it lets through although they aren't
listed are the second level's, the listed keys that the second lets through are the third's, and so on until a
level lets nothing wrong through. A key's verdict is the first level that rejects it: an even level (from 0) says
not listed, an odd one listed; a key that passes all is listed if their number is odd. Over the universe that
the cascade was built on this is exact, without a join; keys outside it may be judged wrong, so the universe
holds every key of the corpus.

A level is a bit array in 64-bit words. Keys fall in shards by a hash, each with arrays of its own: about SHARD listed
keys, so no array is over some 1.5 MB, whatever the list's size. The arrays stay a table: one row for each shard. They
are broadcast where all of them have at most BROADCAST bytes; a longer list meets the keys by its shard number.
Everything runs as DataFrame expressions; the driver sees only counts.

Rules (host, path, verdict) come first: a rule fits its host and all subdomains if the path starts with the
rule's path; the longest (host, then path) wins.

Defined cases: host and path are empty where the url is null or has no `://`, and an empty host is never listed.
Repeated rows are judged alike; a null page_id is kept; other columns are ignored; an empty list allows all; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, unstage

#: Hash functions of a level (about ten bits a key, rate 2^-HASHES), listed keys of a shard, most bytes of arrays that are broadcast.
HASHES, SHARD, BROADCAST = 7, 1 << 20, 64 << 20
# The rules of the query, and the names whose hosts it lists.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
LISTED = r"(^|\.)(spam-farm|cheap-pills)\."


def host_of(url: Column) -> Column:
    """From after the first :// to a slash, question mark, number sign or the end; A-Z lower-cased."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to a question mark, number sign or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The name of the rule that wins (like net/es/) and its verdict, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]), len(r[1]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _place(key: Column, level: int, i: int, bits: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(level * 64 + i), key), bits)


def _level(keys: DataFrame, level: int) -> DataFrame:
    """(shard, bits, words) of the level that encodes keys (shard, key): words in order, zero words between."""
    sizes = keys.groupBy("shard").agg((64 * F.ceil(F.greatest(F.lit(64), F.count("*") * HASHES * 1.45) / 64)).cast("long").alias("bits"))
    sized = keys.join(F.broadcast(sizes), "shard")  # one row a shard
    places = sized.select("shard", "bits", F.explode(F.array(*[_place(F.col("key"), level, i, F.col("bits")) for i in range(HASHES)])).alias("at"))
    words = places.select("shard", "bits", F.floor(F.col("at") / 64).cast("int").alias("w"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("b")).groupBy("shard", "bits", "w").agg(F.bit_or("b").alias("b"))
    filled = words.groupBy("shard", "bits").agg(F.map_from_entries(F.collect_list(F.struct("w", "b"))).alias("m"))
    return filled.select("shard", "bits", F.transform(F.sequence(F.lit(0), (F.col("bits") / 64).cast("int") - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("words"))


def _passes(key: Column, level: int, bits: Column, words: Column) -> Column:
    """Whether a level lets a key through; a shard without the level lets none."""
    out = words.isNotNull()
    for i in range(HASHES):
        at = _place(key, level, i, bits)
        out = out & (F.getbit(F.get(words, F.floor(at / 64).cast("int")), (at % 64).cast("int")) == 1)
    return F.coalesce(out, F.lit(False))


class Cascade:
    """The levels of a cascade: a table of (shard, bits0, words0, bits1, words1, ...)."""

    def __init__(self, table: DataFrame | None, levels: int, shards: int, size: int):
        self.table, self.levels, self.shards, self.size = table, levels, shards, size

    def shard(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit("shard"), key), F.lit(self.shards))

    def mark(self, df: DataFrame, key: Column, name: str = "listed") -> DataFrame:
        """df with a column that says whether a key of the universe is listed."""
        if self.table is None:
            return df.withColumn(name, F.lit(False))
        table = F.broadcast(self.table) if self.size <= BROADCAST else self.table
        rows = df.select(F.struct("*").alias("row"), key.alias("key")).withColumn("shard", self.shard(F.col("key"))).join(table, "shard", "left")
        out = F.lit(self.levels % 2 == 1)
        for level in range(self.levels - 1, -1, -1):
            out = F.when(~_passes(F.col("key"), level, F.col(f"bits{level}"), F.col(f"words{level}")), F.lit(level % 2 == 1)).otherwise(out)
        return rows.select("row.*", out.alias(name))


def build(universe: DataFrame, listed: DataFrame, *, per_shard: int = SHARD) -> Cascade:
    """The cascade of listed keys over a universe, both of one column `key`; listed keys outside it join it."""
    inside = stage(listed.filter("key is not null").distinct(), "listed")
    cascade = Cascade(None, 0, 1 + inside.count() // per_shard, 0)
    of = lambda df: df.select(cascade.shard(F.col("key")).alias("shard"), "key")
    outside = stage(of(universe.filter("key is not null").distinct().join(inside, "key", "left_anti")), "others")
    inside = of(inside)
    while not inside.isEmpty():
        level = cascade.levels
        made = stage(_level(inside, level), f"level{level}")
        size = made.agg(F.sum("bits")).first()[0] // 8
        small = F.broadcast(made) if size <= BROADCAST else made
        wrong = stage(outside.join(small, "shard").filter(_passes(F.col("key"), level, F.col("bits"), F.col("words"))).select("shard", "key"), f"passed{level}")
        unstage(outside)
        inside, outside = wrong, inside
        made = made.select("shard", F.col("bits").alias(f"bits{level}"), F.col("words").alias(f"words{level}"))
        cascade.table = made if cascade.table is None else cascade.table.join(made, "shard", "full")
        cascade.levels, cascade.size = level + 1, cascade.size + size
    if cascade.table is not None:
        cascade.table = stage(cascade.table, "cascade")
    return cascade


def judge(pages: DataFrame, listed: DataFrame | None = None, rules=RULES, pattern: str = LISTED) -> DataFrame:
    """(page_id, host, path, rule, verdict); listed: keys (hosts) to block, by default the corpus's hosts that match a pattern."""
    rows = pages.select(pages["page_id"].alias("page_id"), host_of(pages["url"]).alias("host"), path_of(pages["url"]).alias("path"))
    hosts = stage(rows.select(F.col("host").alias("key")).distinct(), "hosts")
    cascade = build(hosts, hosts.filter(F.col("key").rlike(pattern)) if listed is None else listed)
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    marked = cascade.mark(rows, F.col("host"))
    blocked = F.col("listed") & (F.col("host") != "")
    return marked.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(said, F.when(blocked, "block").otherwise("allow")).alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


SQL = r"""
WITH p AS (
  SELECT page_id,
    CASE WHEN instr(url, '://') > 0 THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
r AS (SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(host, '(^|\.)(spam-farm|cheap-pills)\.') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
