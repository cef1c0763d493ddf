"""Context for candidates (query_id, path, query): the own document and an augmentation, under separate budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import LINE_END, context_token_count, let, line_bounds, tokenize
from ..sources.staging import stage_facts as stage
from . import graph, retrieval, slices
from .rules import security_focus


def shares(ranked: DataFrame, budget: int, *, key: str = "query_id") -> DataFrame:
    """ranked (key, rank) with each row's share of a budget.

    The first row gets an equal share or half of the budget up to 512, whichever is more, leaving one for each
    other; the rest is dealt evenly, earlier rows first.
    """
    n = F.count("*").over(Window.partitionBy(key))
    rows = ranked.withColumn("n", n).withColumn("i", F.row_number().over(Window.partitionBy(key).orderBy("rank")) - 1)
    equal = F.floor(F.lit(budget) / F.col("n"))
    first = F.least(F.lit(budget) - (F.col("n") - 1), F.greatest(equal, F.lit(min(512, budget // 2))))
    rest, others = F.lit(budget) - first, F.greatest(F.col("n") - 1, F.lit(1))
    other = F.floor(rest / others) + F.when(F.col("i") - 1 < rest % others, 1).otherwise(0)
    flat = F.greatest(F.lit(1), equal)
    share = F.when((F.col("n") == 1) | (F.lit(budget) < F.col("n")), flat).when(F.col("i") == 0, first).otherwise(other)
    return rows.withColumn("share", share.cast("long")).drop("n", "i")


def augmentation(docs: DataFrame, edges: DataFrame, candidates: DataFrame, mode: str, top_k: int, hops: int, direction: str = "forward") -> DataFrame:
    """(query_id, path, rank) of what is read beside a candidate's document: by words, by calls, or by both in turn (hybrid)."""
    own = candidates.select("query_id", "path")

    def lexical(pairs: DataFrame | None = None) -> DataFrame:
        return retrieval.tfidf(docs, candidates, F.col("text"), F.col("query"), F.col("query").rlike(r"/|::|\.|\\"), pairs)

    def others(found: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy("rank")
        return found.join(own, ["query_id", "path"], "left_anti").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "path", "rank")

    def near(seeds: DataFrame, graph_edges: DataFrame) -> DataFrame:
        reached = graph.distances(seeds.select("path").distinct(), graph_edges, hops)
        found = stage(seeds.select("query_id", F.col("path").alias("seed")).join(reached, "seed"), "reached")
        found = found.join(lexical(found).withColumnRenamed("score", "lexical"), ["query_id", "path"], "left")
        return others(retrieval.graph_rank(found.select("query_id", "path", "distance", "lexical"), top_k + 1), top_k)

    if mode == "text":
        return others(retrieval.top_k(lexical(), 3 * top_k), top_k)
    if mode == "graph":
        ways = {"forward": edges, "reverse": graph.reverse(edges), "both": edges.union(graph.reverse(edges))}
        return near(own, ways[direction])
    if mode != "hybrid":
        raise ValueError(f"unsupported retrieval mode: {mode}")
    words = stage(retrieval.top_k(lexical(), max(2, top_k + 1)), "words")
    best = others(words, 1)
    return retrieval.hybrid([near(own, edges), others(words, top_k), near(best, edges)], 3 * top_k).select("query_id", "path", "rank")


def retrieve(docs: DataFrame, edges: DataFrame, candidates: DataFrame, mode: str, *, base_tokens: int = 512, more_tokens: int = 1488, top_k: int = 10, hops: int = 4, direction: str = "forward") -> DataFrame:
    """Evidence (query_id, path, text, rank, part) of candidates by mode local, text, graph or hybrid.

    The own document comes first; the candidate's document never is its own augmentation. A text that is longer than
    its share is read around the line that fits the query best (the candidate's own line, where candidates have a
    column `line`, if none does); of what calls lead to, the lines that its sinks depend on come first, if they fit.
    """
    named = candidates.withColumn("line", F.col("line") if "line" in candidates.columns else F.lit(None).cast("int"))
    first, last = (line_bounds(F.col("path"))[x] for x in ("first", "last"))
    fallback = F.when(F.col("line").between(first, last), F.col("line") - first + 1).otherwise(1)
    own = named.select("query_id", "path", "query", fallback.cast("int").alias("fallback")).join(docs.select("path", "text"), "path")
    own = focused(own, base_tokens, F.col("query"), F.col("fallback")).select("query_id", "path", "text", F.lit(0).alias("rank"), F.lit("base").alias("part"))
    base = retrieval.limit_budget(own, base_tokens).drop("n_tokens")
    if mode == "local":
        return base
    other = stage(augmentation(docs, edges, candidates, mode, top_k, hops, direction), "augmentation")
    dealt = shares(other, more_tokens).join(docs.select("path", "text"), "path").join(candidates.select("query_id", "query"), "query_id")
    texts = focused(dealt, F.col("share").cast("int"), F.col("query"), F.lit(1), security=mode != "text").select("query_id", "path", "rank", "share", "text")
    if mode != "text":
        long = docs.join(other.select("path").distinct(), "path", "left_semi").filter(context_token_count(F.col("text")) > F.lit(more_tokens) / (2 * top_k))
        # Short texts are read whole: slices are asked only where a text is longer than the least share.
        sliced = slices.compact_texts(long.select("path", "text")).select("path", F.col("text").alias("slice"), F.col("n_tokens").alias("slice_tokens"))
        whole = docs.select("path", context_token_count(F.col("text")).alias("all_tokens"))
        texts = texts.join(whole, "path").join(sliced, "path", "left").withColumn("text", F.when((F.col("all_tokens") > F.col("share")) & (F.col("slice_tokens") <= F.col("share")), F.col("slice")).otherwise(F.col("text")))
    more = retrieval.limit_budget(texts.select("query_id", "path", "text", "rank", F.lit("augmentation").alias("part")), more_tokens).drop("n_tokens")
    return base.unionByName(more)


def _lines(text: Column) -> Column:
    """The lines of a text that is not empty, with their ends; a text whose only line ends are \\n is split at those."""
    other = r"\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
    plain = let(F.split(text, "\n", -1), lambda ls: F.filter(F.transform(ls, lambda x, i: F.when(i < F.size(ls) - 1, F.concat(x, F.lit("\n"))).otherwise(x)), lambda x: x != ""))
    return F.when(text.rlike(f"[{other}]"), F.regexp_extract_all(text, F.lit(f"[^\\n{other}]*(?:{LINE_END})|[^\\n{other}]+"), F.lit(0))).otherwise(plain)


def focused(rows: DataFrame, budget: int | Column, query: Column, fallback: Column, *, security: bool = False) -> DataFrame:
    """rows (text, ...) with text cut to a window of lines of at most `budget` tokens, and center, first, last (lines from 0, last exclusive) and n_tokens.

    The centre is the line with the best (security score, distinct query terms, nearness to the fallback line, place);
    without any score it is the fallback line (from 1). The window grows by a line before, then a line behind, as long
    as one of them fits; a centre that is too long is cut behind a token. A text within the budget stays whole.
    """
    if not isinstance(budget, Column) and (isinstance(budget, bool) or budget < 1):
        raise ValueError("context token budget must be positive")
    budget = budget if isinstance(budget, Column) else F.lit(budget)
    held = rows.filter(F.length("text") > 0).withColumn("lines_", _lines(F.col("text")))
    asked = F.array_distinct(tokenize(query))
    # Only terms that are asked are taken from a line: an identifier is a run of its letters without the digits before it.
    term = F.when(F.size(asked) > 0, F.concat(F.lit("(?i)(?<![a-z0-9_])[0-9]*+("), F.array_join(asked, "|"), F.lit(")(?![a-z0-9_])"))).when(F.size(asked) == 0, "(?!)()")
    held = held.withColumns({"near_": F.least(F.greatest(fallback - 1, F.lit(0)), F.size("lines_") - 1), "term_": term})
    terms = lambda line: F.size(F.array_distinct(F.transform(F.regexp_extract_all(line, F.col("term_"), F.lit(1)), lambda t: F.lower(t))))
    score = lambda line, i: F.struct((security_focus(line) if security else F.lit(0)).alias("s"), terms(line).alias("q"), (-F.abs(i - F.col("near_"))).alias("d"), i.alias("i"))
    held = held.withColumn("best_", F.array_max(F.transform("lines_", score)))
    held = held.withColumn("center", F.when((F.col("best_.s") > 0) | (F.col("best_.q") > 0), F.col("best_.i")).otherwise(F.col("near_")))
    all_, count = F.size("lines_"), lambda i: context_token_count(F.get("lines_", i))

    # Tokens are counted as the window meets a line, once for each: a side whose next line doesn't fit stays shut.
    def grow(a, _):
        def behind(b):
            up = F.coalesce(b <= budget, F.lit(False))
            n = F.when(up, b).otherwise(a["n"])
            fits = lambda c: F.struct(F.when(up, a["first"] - 1).otherwise(a["first"]).alias("first"), F.when(c <= budget, a["last"] + 1).otherwise(a["last"]).alias("last"), F.when(c <= budget, c).otherwise(n).alias("n"), up.alias("up"), F.coalesce(c <= budget, F.lit(False)).alias("down"))
            return let(F.when(a["down"] & (a["last"] < all_), n + count(a["last"])), fits)

        return F.when(a["up"] | a["down"], let(F.when(a["up"] & (a["first"] > 0), a["n"] + count(a["first"] - 1)), behind)).otherwise(a)

    held = held.withColumn("center_n_", count(F.col("center")))
    window = lambda first, last, n, grows: F.struct(first.alias("first"), last.alias("last"), n.alias("n"), F.lit(grows).alias("up"), F.lit(grows).alias("down"))
    center, n = F.col("center"), F.col("center_n_")
    whole = (n == budget) & (context_token_count(F.col("text")) <= budget)
    grown = F.aggregate(F.sequence(F.lit(1), all_), window(center, center + 1, n, True), grow)
    held = held.withColumn("window_", F.when(whole, window(F.lit(0), all_, n, False)).when(n >= budget, window(center, center + 1, n, False)).otherwise(grown))
    body = F.array_join(F.slice("lines_", F.col("window_.first") + 1, F.col("window_.last") - F.col("window_.first")), "")
    tokens = F.slice(F.regexp_extract_all(body, F.lit(r"(?U)\s*(?:\w+|[^\w\s])"), F.lit(0)), F.lit(1), budget)
    text = F.when(F.col("window_.n") <= budget, body).otherwise(F.array_join(tokens, ""))
    keep = [c for c in rows.columns if c != "text"]
    return held.select(*keep, text.alias("text"), "center", "window_.first", "window_.last", F.least(F.col("window_.n"), budget).alias("n_tokens"))
