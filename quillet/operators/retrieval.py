"""Lexical retrieval over a documents table (path, text): term statistics, scores, top-k, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import CONTEXT_TOKEN, tokenize
from ..sources.staging import stage

#: Scores are rounded before ranking, since sums of doubles depend on their order.
DIGITS = 9
# What looks like part of a path in a query, and a query that looks like a path.
FRAGMENT = r"[A-Za-z0-9_./\\-]+\.[A-Za-z0-9_./\\-]+"
PATH_LIKE = r"/|::|\.|\\"
#: Documents of a partition, so that the scores of all queries fit a task's memory; terms that are sent to all tasks, at most.
DOCUMENTS, SENT = 8192, 200_000


def terms(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, term, tf) with the key's length (all its terms) as len."""
    each = rows.select(F.col(key), F.explode(tokenize(text)).alias("term"))
    return each.groupBy(key, "term").agg(F.count("*").alias("tf"))


def corpus_size(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("n_docs"))


def inverse_frequency(tf: DataFrame, docs: DataFrame) -> DataFrame:
    """(term, df, idf): ln((N + 1) / (df + 1)) + 1 over the whole corpus."""
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1
    return df.join(F.broadcast(corpus_size(docs)), F.lit(True)).select("term", "df", idf.alias("idf"))  # one row


def parts_of(docs: DataFrame) -> int:
    """As many partitions as the documents' number asks for."""
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // DOCUMENTS))


def asked_terms(docs: DataFrame, text: Column, asked: DataFrame) -> DataFrame:
    """(path, len, term, tf): the terms of asked (term) that documents hold, with the length of the whole document.

    Terms that nobody asks for leave where they arise, if the asked ones are few enough to be sent to all tasks; a
    document's length comes with its row.
    """
    each = docs.select("path", tokenize(text).alias("t")).select("path", F.size("t").alias("len"), F.explode("t").alias("term"))
    return each.join(_sent(asked.select("term").distinct()), "term", "left_semi").groupBy("path", "len", "term").agg(F.count("*").alias("tf"))


def _sent(rows: DataFrame) -> DataFrame:
    """rows, sent to all tasks where they are few: then what they meet stays where it is."""
    return F.broadcast(rows) if rows.limit(SENT + 1).count() <= SENT else rows.hint("merge")


def weighed(tf: DataFrame, asked: DataFrame) -> DataFrame:
    """asked with df, the number of documents that hold the term; terms that none holds leave."""
    return _sent(stage(asked.join(tf.groupBy("term").agg(F.count("*").alias("df")), "term"), "weights"))


def bm25(docs: DataFrame, queries: DataFrame, text: Column, query: Column) -> DataFrame:
    """(query_id, path, score): sum of idf * tf * 2.2 / (tf + 1.2 (0.25 + 0.75 len / average)) over distinct query terms."""
    asked = stage(queries.select("query_id", F.explode(F.array_distinct(tokenize(query))).alias("term")), "asked")
    # All rows of a path lie in one partition, so that scores add up where they arise.
    tf = asked_terms(docs.repartition(parts_of(docs), "path"), text, asked)
    size = docs.agg(F.count("*").alias("n_docs"), F.sum(F.size(tokenize(text))).alias("total"))
    hits = tf.join(weighed(tf, asked), "term").join(F.broadcast(size), F.lit(True))  # one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = 1.2 * (0.25 + 0.75 * F.col("len") / (F.col("total") / F.col("n_docs")))
    score = idf * F.col("tf") * 2.2 / (F.col("tf") + norm)
    return hits.groupBy("query_id", "path").agg(F.round(F.sum(score), DIGITS).alias("score"))


def tfidf(docs: DataFrame, queries: DataFrame, text: Column, query: Column, path_like: Column, pairs: DataFrame | None = None) -> DataFrame:
    """(query_id, path, score): sum of q (1 + ln tf) idf; where path_like holds, q (4 + ln ptf) for terms of the path as well.

    A path that holds a path-like query whole gets 50 more, and 1000 more for each of the query's path fragments it holds.
    With pairs (query_id, path) only those are scored, in work that grows with the pairs and not with what terms share.
    """
    asked = queries.select("query_id", path_like.alias("path_like"), F.explode(tokenize(query)).alias("term"))
    asked = stage(asked.groupBy("query_id", "path_like", "term").agg(F.count("*").alias("q")), "asked")
    # All rows of a path lie in one partition, so that scores add up where they arise.
    parts = parts_of(docs)
    placed = docs.repartition(parts, "path")
    tf = asked_terms(placed, text, asked)
    idf = F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1
    meet = lambda held, wanted: held.join(wanted, "term") if pairs is None else wanted.join(pairs.select("query_id", "path").distinct(), "query_id").join(held, ["path", "term"])
    body = meet(tf, weighed(tf, asked)).join(F.broadcast(corpus_size(docs)), F.lit(True)).select("query_id", "path", (F.col("q") * (1 + F.log("tf")) * idf).alias("s"))  # one row
    named = meet(asked_terms(placed, F.col("path"), asked.filter("path_like")), _sent(asked.filter("path_like"))).select("query_id", "path", (F.col("q") * (4 + F.log("tf"))).alias("s"))
    bonus = path_bonus(docs, queries, query, path_like, pairs).select("query_id", "path", F.col("bonus").cast("double").alias("s"))
    return body.union(named).union(bonus.repartition(parts, "path")).groupBy("query_id", "path").agg(F.round(F.sum("s"), DIGITS).alias("score"))


def grams(text: Column) -> Column:
    """The distinct runs of one to three characters of a text."""
    runs = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substr(text, i, F.lit(n)))).otherwise(F.expr("cast(array() as array<string>)"))
    return F.array_distinct(F.concat(runs(1), runs(2), runs(3)))


def path_bonus(docs: DataFrame, queries: DataFrame, query: Column, path_like: Column, pairs: DataFrame | None = None) -> DataFrame:
    """(query_id, path, bonus) of documents whose path holds the query (50, where it is path-like) or its path fragments (1000 each).

    Fragments meet paths by an equi-join on the run of three characters of theirs (fewer, if shorter) that the fewest
    paths have; whether the path holds them is asked behind it.
    """
    low = F.lower(query)
    parts = F.array_distinct(F.transform(F.regexp_extract_all(low, F.lit(FRAGMENT), F.lit(0)), lambda x: F.regexp_replace(x, "^[.,;:]+|[.,;:]+$", "")))
    whole = F.when(path_like & (F.trim(low) != ""), F.array(F.struct(F.trim(low).alias("part"), F.lit(50).alias("worth")))).otherwise(F.expr("cast(array() as array<struct<part:string,worth:int>>)"))
    found = queries.select("query_id", F.explode(F.concat(whole, F.transform(parts, lambda x: F.struct(x.alias("part"), F.lit(1000).alias("worth"))))).alias("w")).select("query_id", "w.part", "w.worth").filter("part <> ''")
    if pairs is not None:
        hit = found.join(pairs.select("query_id", "path").distinct(), "query_id")
        return hit.filter(F.contains(F.lower("path"), F.col("part"))).groupBy("query_id", "path").agg(F.sum("worth").alias("bonus"))
    held = docs.select("path", F.explode(grams(F.lower("path"))).alias("gram"))
    own = F.filter(grams(F.col("part")), lambda g: F.length(g) == F.least(F.length("part"), F.lit(3)))
    rare = found.select("part").distinct().select("part", F.explode(own).alias("gram")).join(held.groupBy("gram").agg(F.count("*").alias("n")), "gram")
    # The runs of all paths never go to the driver, whatever their size is taken for.
    rare = _sent(stage(rare.groupBy("part").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram")), "rare"))
    places = rare.join(held, "gram").filter(F.contains(F.lower("path"), F.col("part"))).select("part", "path")
    return found.join(places, "part").groupBy("query_id", "path").agg(F.sum("worth").alias("bonus"))


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query by (-score, path), with rank; only then scores of zero or less go."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "path")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).filter("score > 0")


def limit_budget(evidence: DataFrame, budget: int, *, key: str = "query_id") -> DataFrame:
    """Ranked evidence (key, rank, text) until a token budget is spent; the row that crosses it ends at a token's end.

    Adds n_tokens (kept) and replaces text; rows without tokens take no part.
    """
    if isinstance(budget, bool) or budget < 1:
        raise ValueError("context token budget must be positive")
    rows = evidence.withColumn("n", F.size(F.regexp_extract_all("text", F.lit(CONTEXT_TOKEN), F.lit(0)))).filter("n > 0")
    spent = F.sum("n").over(Window.partitionBy(key).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    rows = rows.withColumn("room", F.lit(budget) - spent).filter("room > 0")
    # Tokens with the white space ahead of them, joined again: a prefix of the text.
    tokens = F.slice(F.regexp_extract_all("text", F.lit(r"(?U)\s*(?:\w+|[^\w\s])"), F.lit(0)), F.lit(1), F.col("room").cast("int"))
    cut = F.when(F.col("n") <= F.col("room"), F.col("text")).otherwise(F.array_join(tokens, ""))
    return rows.withColumn("text", cut).withColumn("n_tokens", F.least("n", "room")).drop("n", "room")


def graph_rank(found: DataFrame, k: int, *, by_distance: bool = False) -> DataFrame:
    """Top k of (query_id, path, distance, lexical) by lexical + 1 / (1 + distance), or by distance first."""
    scored = found.withColumn("score", F.round(F.coalesce("lexical", F.lit(0.0)) + 1 / (1 + F.col("distance")), DIGITS))
    first = F.col("distance") if by_distance else F.lit(0)
    order = Window.partitionBy("query_id").orderBy(first, F.desc("score"), "distance", "path")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hybrid(branches: list[DataFrame], k: int) -> DataFrame:
    """Ordered union of ranked branches (query_id, path, rank): the first branch's hit wins, k rows a query."""
    rows = branches[0].select("query_id", "path", "rank", F.lit(0).alias("branch"))
    for place, b in enumerate(branches[1:], 1):
        rows = rows.unionByName(b.select("query_id", "path", "rank", F.lit(place).alias("branch")))
    first = rows.groupBy("query_id", "path").agg(F.min(F.struct("branch", F.col("rank").alias("r"))).alias("at"))
    order = Window.partitionBy("query_id").orderBy("at.branch", "at.r", "path")
    return first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "path", "at.branch", "rank")
