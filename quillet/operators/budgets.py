"""Evidence that fits a budget once it stands in a prompt's JSON: in order of rank, what does not fit is cut or passed over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import let, running

#: Tokens of text in JSON; the pieces that a text may be cut behind, each with the white space ahead of it.
JSON_TOKEN = r"\w+|[^\w\s]"
PIECE = r"(?U)\s*(?:\w+|[^\w\s])"
FIELDS = ("evidence_id", "graph_distance", "path", "retrieval", "text")


def escaped(text: Column) -> Column:
    """A text as it stands in ASCII JSON, but with \\u0000 for the code of any other character: what matters here is its length and its tokens."""
    out = F.regexp_replace(text, r'([\\"])', r"\\$1")
    for mark, name in (("\n", "n"), ("\r", "r"), ("\t", "t"), ("\b", "b"), ("\f", "f")):
        out = F.replace(out, F.lit(mark), F.lit(f"\\{name}"))
    out = F.regexp_replace(out, r"[\x{10000}-\x{10FFFF}]", r"\\u0000\\u0000")
    return F.regexp_replace(out, r"[^\x20-\x7f]", r"\\u0000")


def _size(text: Column, unit: str) -> Column:
    """Size of escaped text: lexical tokens, or bytes as an upper bound of any tokens."""
    return F.size(F.regexp_extract_all(text, F.lit(JSON_TOKEN), F.lit(0))) if unit == "tokens" else F.octet_length(text)


def prefix_sizes(text: Column, unit: str = "tokens") -> Column:
    """array<int>: the size in JSON of the text up to each place where it may be cut (behind a token; in bytes, behind a character).

    A piece that begins in JSON with a word character behind one that ends with one (behind an escape) makes one token with it.
    """
    pieces = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)) if unit == "tokens" else F.filter(F.split(text, ""), lambda c: c != "")

    def sized(said: Column) -> Column:
        sizes = F.transform(said, lambda p: _size(p, unit))
        if unit == "tokens":
            joins = F.zip_with(F.slice(said, F.lit(2), F.greatest(F.size(said) - 1, F.lit(0))), said, lambda p, before: F.when(p.rlike(r"^\w") & before.rlike(r"\w$"), 1).otherwise(0))
            sizes = F.zip_with(sizes, F.concat(F.array(F.lit(0)), joins), lambda n, j: n - F.coalesce(j, F.lit(0)))
            sizes = F.filter(sizes, lambda n: n.isNotNull())
        return F.zip_with(running(sizes), sizes, lambda before, n: before + n)

    return let(F.transform(pieces, escaped), sized)


def item_frame(evidence_id: Column, distance: Column, path: Column, retrieval: Column) -> Column:
    """An evidence item's JSON without its text."""
    text = lambda c: F.coalesce(escaped(c.cast("string")), F.lit(""))
    return F.concat(F.lit('{"evidence_id":"'), text(evidence_id), F.lit('","graph_distance":'), F.coalesce(distance.cast("string"), F.lit("null")), F.lit(',"path":"'), text(path), F.lit('","retrieval":"'), text(retrieval), F.lit('","text":""}'))


def fitted(items: DataFrame, budget: Column, frame: Column, *, key: str = "query_id", top_k: int = 8, unit: str = "tokens") -> DataFrame:
    """(key, rank, text, size, total) of the items that stand in each key's prompt.

    items has (key, rank, evidence_id, graph_distance, path, retrieval, text); budget and frame (the prompt's JSON
    without items) may differ by key. Items come in order of rank, the first top_k of a key: one that fits whole is
    taken, a longer one is cut to the longest prefix that fits, and one of which nothing fits is passed over, so that a
    later, smaller one may still be taken. size counts the item in JSON with its comma, total the whole prompt.
    Defined cases: null text counts as empty and is taken if its frame fits; equal ranks go by evidence_id; a prompt
    whose frame alone is over the budget is an error.
    """
    whole = F.coalesce("text", F.lit(""))
    base = _size(item_frame(F.col("evidence_id"), F.col("graph_distance"), F.col("path"), F.col("retrieval")), unit)
    rows = items.select(key, F.row_number().over(Window.partitionBy(key).orderBy("rank", "evidence_id")).alias("place"), "rank", whole.alias("text"), base.alias("base"), budget.cast("int").alias("budget"), _size(frame, unit).alias("frame")).filter(F.col("place") <= top_k)
    rows = rows.withColumns({"full": _size(escaped(F.col("text")), unit), "sizes": prefix_sizes(F.col("text"), unit)})
    rows = rows.withColumn("budget", F.when(F.col("frame") <= F.col("budget"), F.col("budget")).otherwise(F.raise_error(F.lit("candidate descriptor exceeds the model context budget")).cast("int")))
    items_of = F.array_sort(F.collect_list(F.struct("place", "rank", "base", "full", "sizes")))
    keys = rows.groupBy(key).agg(F.min("budget").alias("budget"), F.min("frame").alias("frame"), items_of.alias("items"))
    none = F.expr("cast(array() as array<struct<place:int,keep:int,size:int>>)")

    def take(a: Column, x: Column) -> Column:
        base = x["base"] + F.when(F.size(a["out"]) > 0, 1).otherwise(0)
        room = a["room"] - base
        # How much of the text fits: all of it (-1), so many pieces, or nothing (null).
        pieces = F.size(F.filter(x["sizes"], lambda n: n <= room))
        keep = F.when(room < 0, F.lit(None)).when(x["full"] <= room, -1).when(pieces > 0, pieces)
        size = base + F.when(keep == -1, x["full"]).otherwise(F.get(x["sizes"], keep - 1))
        return F.when(keep.isNull(), a).otherwise(F.struct((a["room"] - size).alias("room"), F.concat(a["out"], F.array(F.struct(x["place"].alias("place"), keep.cast("int").alias("keep"), size.cast("int").alias("size")))).alias("out")))

    start = F.struct((F.col("budget") - F.col("frame")).cast("int").alias("room"), none.alias("out"))
    done = keys.select(key, "budget", F.aggregate("items", start, take).alias("done")).select(key, (F.col("budget") - F.col("done.room")).alias("total"), F.inline("done.out"))
    pieces = F.regexp_extract_all("text", F.lit(PIECE), F.lit(0)) if unit == "tokens" else F.filter(F.split("text", ""), lambda c: c != "")
    cut = F.when(F.col("keep") == -1, F.col("text")).otherwise(F.array_join(F.slice(pieces, F.lit(1), F.greatest("keep", F.lit(0))), ""))
    return rows.select(key, "place", "rank", "text").join(done, [key, "place"]).select(key, "rank", cut.alias("text"), "size", "total")
