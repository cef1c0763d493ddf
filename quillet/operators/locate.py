"""Places in files: the span around a line, the nearest document, matches of locations, merged ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Lines in a bin of the range join: a span stands in each bin that it touches, a line in one.
BIN = 256


def enclosing_span(points: DataFrame, spans: DataFrame) -> DataFrame:
    """points (point_id, file, line) with the smallest span (file, first, last, path) around the line, or null; ties by first, then path."""
    cell = lambda c: F.floor(F.col(c) / BIN)
    binned = spans.withColumn("bin", F.explode(F.sequence(cell("first"), cell("last"))))
    inside = points.withColumn("bin", cell("line")).join(binned, ["file", "bin"]).filter("first <= line and line <= last")
    best = inside.groupBy("point_id").agg(F.min(F.struct((F.col("last") - F.col("first")).alias("size"), "first", "path")).alias("b"))
    return points.join(best, "point_id", "left").select("point_id", "file", "line", F.col("b.path").alias("path"))


def candidate_document(points: DataFrame, spans: DataFrame) -> DataFrame:
    """points (point_id, file, line, symbol) with one document of their file (file, symbol, first, last, path).

    The wanted symbol comes first, then the smallest span around the line, else the nearest begin; ties by path.

    No point meets all spans of its file: the smallest span of a symbol, the spans around a line and the begins beside it
    are looked up each by an equi-join. A nearest begin counts only where neither of the others is found, and a span
    around a line only where no symbol is, so each may be looked for among all spans.
    """
    cell = lambda c: F.floor(F.col(c) / BIN)
    size = (F.col("last") - F.col("first")).alias("cost")
    best = lambda rows, *keys: rows.groupBy(*keys).agg(F.min(F.struct("cost", "path")).alias("b")).select(*keys, "b.cost", "b.path")
    out = lambda tier: ("point_id", F.lit(tier).alias("tier"), "cost", "path")
    named = best(spans.select(F.col("file").alias("in"), "symbol", size, "path").withColumnRenamed("symbol", "own"), "in", "own")
    found = points.join(named, (F.col("file") == F.col("in")) & F.col("symbol").eqNullSafe(F.col("own"))).select(*out(0))
    # A span stands at the level of bins as long as itself, in two of them at most.
    level = F.greatest(F.ceil(F.log2(F.col("last") - F.col("first") + 1)), F.lit(8)).cast("int")
    at = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), "level"))
    held = best(spans.filter("first <= last").select("file", "first", "last", size, "path"), "file", "first", "last").withColumn("level", level)
    levels = points.join(held.select("file", "level").distinct(), "file").withColumn("bin", at("line"))
    around = levels.join(held.withColumn("bin", F.explode(F.sequence(at("first"), at("last")))), ["file", "level", "bin"]).filter("first <= line and line <= last")
    found = found.union(around.select(*out(1)))
    # Begins of the line's own bin, the last one of the bin with begins before it and the first one of that behind it.
    begins = spans.filter("first is not null").groupBy("file", "first").agg(F.min(F.struct("path")).alias("p")).select("file", "first", "p.path", cell("first").alias("bin"))
    lines = points.filter("line is not null").select("point_id", "file", "line", cell("line").alias("bin"))
    ends = begins.groupBy("file", "bin").agg(F.min(F.struct("first", "path")).alias("low"), F.max_by(F.struct("first", "path"), "first").alias("high"))
    bins = lines.select("file", "bin").distinct().join(ends, ["file", "bin"], "full_outer")
    order = Window.partitionBy("file").orderBy("bin")
    before = F.last("high", True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    behind = F.last("low", True).over(Window.partitionBy("file").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1))
    beside = bins.select("file", "bin", before.alias("x"), behind.alias("y")).select("file", "bin", F.explode(F.array("x", "y")).alias("s")).filter("s is not null").select("file", "bin", "s.first", "s.path")
    near = lines.join(beside.union(begins.select("file", "bin", "first", "path")), ["file", "bin"])
    found = found.union(near.withColumn("cost", F.abs(F.col("first") - F.col("line"))).select(*out(2)))
    # Without a begin or a line there is no distance; such spans come before others.
    unknown = spans.groupBy("file").agg(F.min(F.struct("path")).alias("any"), F.min(F.when(F.col("first").isNull(), F.struct("path"))).alias("none"))
    lost = points.join(unknown, "file").withColumn("p", F.when(F.col("line").isNull(), F.col("any")).otherwise(F.col("none"))).filter("p is not null")
    found = found.union(lost.select("point_id", F.lit(2).alias("tier"), F.lit(None).cast("long").alias("cost"), "p.path"))
    return found.groupBy("point_id").agg(F.min(F.struct("tier", "cost", "path")).alias("b")).select("point_id", "b.path", "b.tier")


def located(references: DataFrame, candidates: DataFrame) -> DataFrame:
    """References at exactly a candidate's repository, commit, file and line."""
    return references.join(candidates, ["repo", "commit", "file", "line"], "left_semi")


def discovery_report(candidates: DataFrame, results: DataFrame, references: DataFrame) -> DataFrame:
    """One row a system: reference recall of its VULNERABLE predictions, unmatched predictions, statuses.

    candidates (case_id, repo, commit, file, line); results (case_id, system, status, predicted_label);
    references (entry_id, report_id, repo, commit, file, line).
    """
    place = ["repo", "commit", "file", "line"]
    said = results.filter("status = 'completed' and predicted_label = 'VULNERABLE'").join(candidates, "case_id").select("system", "case_id", *place)
    hit = references.join(said.select("system", *place).distinct(), place).groupBy("system").agg(F.count_distinct("entry_id").alias("detected_entries"), F.count_distinct("repo", "report_id").alias("detected_advisories"))
    stray = said.join(references.select(*place).distinct(), place, "left_anti").groupBy("system").agg(F.count_distinct("case_id").alias("unmatched"))
    status = results.groupBy("system").agg(F.count_if(F.col("status").isin("completed", "abstained")).alias("reviewed"))
    totals = references.agg(F.count("*").alias("reference_entries")).join(candidates.agg(F.count("*").alias("candidates")), F.lit(True))
    out = status.join(hit, "system", "left").join(stray, "system", "left").join(F.broadcast(totals), F.lit(True))  # one row
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    recall = F.try_divide(F.coalesce("detected_entries", F.lit(0)).cast("double"), F.col("reference_entries").cast("double"))
    return out.select("system", zero("detected_entries"), zero("detected_advisories"), zero("unmatched"), recall.alias("recall"), (F.col("candidates") - F.col("reviewed")).alias("unreviewed"), (F.col("reviewed") != F.col("candidates")).alias("provisional"))


def merged_ranges(ranges: DataFrame, key: str) -> DataFrame:
    """(key, first, last): ranges united where one begins at or before the end of those before it."""
    order = Window.partitionBy(key).orderBy("first", "last")
    before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col("first") > before), 1).otherwise(0)
    marked = ranges.withColumn("opens", opens).withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("island")
