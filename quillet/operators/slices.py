"""The lines that a document's sinks depend on: assignments, stores, conditions and switches, backwards from the sinks.

Each line is a row with what it binds and needs; names are followed from the sinks to their assignments by
equi-joins on (path, name), at most DEPTH steps, each staged. The nearest condition above a line and the switch
around it come from windows over a document's lines, a store into a collection from a join on the collection and its
key. Only names and line numbers move between tasks, no texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.command import STRING_LITERAL, value_identifiers
from ..sources.staging import stage
from .rules import lines

# Patterns of assignments, conditions, calls and collections in code, and names that sinks are about.
ASSIGNMENT = r"^\s*(?:(?:final\s+)?(?:[\w.$<>\[\],?]+\s+)+)?([A-Za-z_$][\w$]*)\s*(?::=|=(?!=))\s*(.+?)\s*;?\s*(?://.*)?$"
INLINE_IF = r"^\s*if\s*\([^)]*\)\s*(.+)$"
IF_CONDITION = r"^\s*if\s*\((.*)\)\s*$"
SWITCH = r"^\s*switch\s*\((.*)\)\s*\{?\s*$"
CALL_ARGUMENT = r"\(([^()]*)\)"
MAP_GET = r"\b([A-Za-z_$][\w$]*)\.get\s*\("
RECEIVER = r"\b([A-Za-z_$][\w$]*)\.[A-Za-z_$][\w$]*\s*\("
TRANSFORM = r"(?i)\b([A-Za-z_$][\w$]*)\.(?:substring|trim|toString|toLowerCase|toUpperCase|replace|split)\s*\("
COLLECTION_GET = r"""\b([A-Za-z_$][\w$]*)\.get\s*\(\s*("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')\s*\)"""
COLLECTION_PUT = r"\b([A-Za-z_$][\w$]*)\.put\s*\(([^;]*)\)"
SINK_FOCUS = r"(?i)(?<![\w.])(?:eval|exec)\s*\(|Runtime\.getRuntime\(\)\.exec|\bProcessBuilder\s*\(|\bsubprocess\.(?:run|popen|call)|\.(?:execute|executeQuery|executeUpdate|prepareStatement|prepareCall)\s*\(|\.search\s*\(|\b(?:FileInputStream|FileOutputStream|FileReader|FileWriter)\s*\(|\.delete\s*\(|shell\s*=\s*True"
SOURCE_FOCUS = r"(?i)\b(?:request|req)\.(?:args|query|body|params|headers|cookies)\b|\brequest\.get(?:Header|Headers|Parameter|ParameterMap|ParameterNames|ParameterValues|Cookies?|QueryString)\s*\(|\.getTheParameter\s*\(|\btheCookie\.getValue\s*\(|\b(?:input\s*\(|sys\.argv\b|os\.environ\b|process\.env\b)"
SINK_VALUE_NAMES = ["bar", "cmd", "command", "file", "filename", "filter", "name", "param", "path", "query", "sql", "value"]
#: Steps from a sink back to assignments, and lines above an assignment in which a condition counts.
DEPTH, NEAR = 6, 4
#: What stands between lines that do not follow each other, and its tokens.
OMITTED, OMITTED_TOKENS = "\n[... omitted non-adjacent context ...]\n", 13
NO_NAMES = "cast(array() as array<string>)"


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _small(names: Column) -> Column:
    return F.filter(names, lambda n: ~n.rlike("^[A-Z]"))


def value_needs(value: Column) -> Column:
    """The names that an assigned value depends on: what it transforms; else receivers, collections and arguments of its calls, or all its names."""
    plain = F.regexp_replace(value, STRING_LITERAL, "")
    changed = F.regexp_extract(plain, TRANSFORM, 1)
    args = value_identifiers(F.array_join(_all(plain, CALL_ARGUMENT), " "))
    receivers = F.concat(_small(_all(plain, RECEIVER)), F.slice(_all(plain, MAP_GET), 1, 1))
    more = F.when(F.size(args) > 0, args).otherwise(value_identifiers(plain))
    return F.array_distinct(F.when((changed != "") & ~changed.rlike("^[A-Z]"), F.array(changed)).otherwise(F.concat(receivers, more)))


def sink_names(line: Column) -> Column:
    """The names that a sink is about: of its arguments (without any, of the line) those that usually carry values, or all."""
    args = _all(line, CALL_ARGUMENT)
    names = value_identifiers(F.when(F.size(args) > 0, F.array_join(args, " ")).otherwise(line))
    known = F.filter(names, lambda n: F.lower(n).isin(*SINK_VALUE_NAMES))
    return F.when(F.size(known) > 0, known).otherwise(names)


def statement_end(code: Column, start: Column) -> Column:
    """Behind the last line (from 0) of the call statement that begins in a line: where its parentheses are closed and a semicolon stands; else the next line."""

    def step(a: Column, line: Column) -> Column:
        plain = F.regexp_replace(line, STRING_LITERAL, "")
        marks = F.split(F.regexp_replace(plain, "[^()]", ""), "")
        depth = F.aggregate(marks, a["depth"], lambda d, c: F.when(c == "(", d + 1).when((c == ")") & (d > 0), d - 1).otherwise(d))
        seen = a["seen"] | F.contains(plain, F.lit("("))
        done = seen & (depth == 0) & F.contains(plain, F.lit(";"))
        return F.when(a["stop"].isNotNull(), a).otherwise(F.struct((a["at"] + 1).alias("at"), depth.alias("depth"), seen.alias("seen"), F.when(done, a["at"] + 1).alias("stop")))

    zero = F.struct(start.alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("seen"), F.lit(None).cast("int").alias("stop"))
    return F.aggregate(F.slice(code, start + 1, F.size(code) - start), zero, step, lambda a: F.coalesce(a["stop"], start + 1))


def line_facts(docs: DataFrame) -> DataFrame:
    """One staged row a line (path, i from 0) of documents (path, text): what it binds and needs, the condition and the switch that it stands under."""
    line = F.trim(F.col("code"))
    said = F.when(line.rlike(ASSIGNMENT), line).otherwise(F.regexp_extract(line, INLINE_IF, 1))
    gets = F.arrays_zip(_all("value", COLLECTION_GET, 1).alias("held"), _all("value", COLLECTION_GET, 2).alias("key"))
    puts = F.zip_with(_all("code", COLLECTION_PUT, 1), _all("code", COLLECTION_PUT, 2), lambda n, a: F.struct(n.alias("held"), T.first_argument(a).alias("a")))
    puts = F.transform(F.filter(puts, lambda p: p["a"].isNotNull()), lambda p: F.struct(p["held"].alias("held"), p["a"]["first"].alias("key"), value_needs(p["a"]["rest"]).alias("needs")))
    rows = lines(docs.select("path", "text")).select("path", (F.col("line") - 1).alias("i"), "code")
    rows = rows.withColumns({"name": F.nullif(F.regexp_extract(said, ASSIGNMENT, 1), F.lit("")), "value": F.regexp_extract(said, ASSIGNMENT, 2), "is_sink": F.col("code").rlike(SINK_FOCUS), "is_source": F.col("code").rlike(SOURCE_FOCUS), "is_switch": line.rlike(SWITCH), "closes": line == "}", "is_if": line.rlike(IF_CONDITION)})
    rows = rows.withColumns({"needs": F.when(F.col("name").isNotNull(), value_needs(F.col("value"))), "gets": gets, "puts": puts, "asked": F.when(F.col("is_if"), value_identifiers(F.regexp_extract(line, IF_CONDITION, 1))).when(F.col("is_switch"), value_identifiers(F.regexp_extract(line, SWITCH, 1)))})
    order = Window.partitionBy("path").orderBy("i")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    # Braces that close nothing do not count: the sum is lifted by its lowest point so far.
    level = F.sum(F.when(F.col("is_switch"), 1).when(F.col("closes"), -1).otherwise(0)).over(so_far)
    rows = rows.withColumn("sum", level).withColumn("depth", F.col("sum") - F.least(F.lit(0), F.min("sum").over(so_far)))
    rows = rows.withColumn("ends", F.col("closes") & (F.lag("depth", 1, 0).over(order) > F.col("depth")))
    near = order.rowsBetween(-NEAR, -1)
    rows = rows.withColumns({"if_at": F.last(F.when(F.col("is_if"), F.col("i")), ignorenulls=True).over(near), "if_asks": F.last(F.when(F.col("is_if"), F.col("asked")), ignorenulls=True).over(near), "first_sink": F.min(F.when(F.col("is_sink"), F.col("i"))).over(Window.partitionBy("path"))})
    around = Window.partitionBy("path", "depth").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"switch_at": F.when(F.col("depth") > 0, F.last(F.when(F.col("is_switch"), F.col("i")), ignorenulls=True).over(around)), "switch_asks": F.when(F.col("depth") > 0, F.last(F.when(F.col("is_switch"), F.col("asked")), ignorenulls=True).over(around))})
    return stage(rows.drop("value", "sum", "asked"), "line-facts")


def kept_lines(docs: DataFrame) -> DataFrame:
    """(path, i) of the lines to keep of documents (path, text): the sinks' statements, the nearest source, and what the sinks depend on.

    A document without sinks keeps its first source, one with neither keeps nothing. Lines count from 0. Texts count
    whole; documents of one path are one document; null and empty texts have no lines.
    """
    facts = line_facts(docs)
    before = facts.filter("name is not null and i < first_sink")
    stores = facts.select("path", F.col("i").alias("put_at"), F.inline("puts")).withColumnRenamed("needs", "put_needs")
    stored = before.select("path", "i", F.inline("gets")).join(stores, ["path", "held", "key"]).filter("put_at < i").groupBy("path", "i").agg(F.collect_set("put_at").alias("put_ats"), F.flatten(F.collect_set("put_needs")).alias("put_needs"))
    none, no_lines = F.expr(NO_NAMES), F.expr("cast(array() as array<int>)")
    found = before.join(stored, ["path", "i"], "left")
    bound = stage(found.select("path", "name", F.array_distinct(F.concat("needs", *[F.coalesce(c, none) for c in ("put_needs", "if_asks", "switch_asks")])).alias("needs"),
        F.concat(F.coalesce("put_ats", no_lines), F.when(F.col("if_at").isNotNull(), F.array("if_at")).otherwise(no_lines), F.when(F.col("switch_at").isNull(), F.array("i")).otherwise(no_lines)).alias("at"), "switch_at"), "bound")
    new = stage(facts.filter("is_sink").select("path", F.explode(sink_names(F.col("code"))).alias("name")).distinct(), "names")
    seen = new
    for _ in range(DEPTH - 1):
        more = new.join(bound, ["path", "name"]).select("path", F.explode("needs").alias("name")).distinct()
        new = stage(more.join(seen, ["path", "name"], "left_anti"), "names")
        if new.isEmpty():
            break
        seen = seen.union(new)
    used = stage(bound.join(seen, ["path", "name"], "left_semi"), "used")
    marks = facts.filter("is_switch or ends").withColumn("level", F.col("depth") + F.col("ends").cast("int"))
    then = Window.partitionBy("path", "level").orderBy("i")
    marks = marks.withColumns({"next": F.lead("i").over(then), "next_ends": F.lead("ends").over(then)})
    switches = marks.filter("is_switch").select("path", F.col("i").alias("switch_at"), F.when(F.col("next_ends"), F.col("next")).otherwise(F.col("i")).alias("last"))
    inside = used.filter("switch_at is not null").select("path", "switch_at").distinct().join(switches, ["path", "switch_at"]).select("path", F.explode(F.sequence("switch_at", "last")).alias("i"))
    code = T.line_array(F.col("text"))
    places = facts.filter("is_sink").groupBy("path").agg(F.collect_list("i").alias("starts"))
    texts = docs.select("path", code.alias("code")).join(places, "path")
    calls = texts.select("path", F.explode(F.transform("starts", lambda s: F.struct(s.alias("s"), statement_end(F.col("code"), s).alias("e")))).alias("r")).select("path", F.explode(F.sequence("r.s", F.col("r.e") - 1)).alias("i"))
    sources = facts.filter("is_source").groupBy("path").agg(F.max(F.when(F.col("i") <= F.col("first_sink"), F.col("i"))).alias("ahead"), F.min("i").alias("first"))
    kept = sources.select("path", F.coalesce("ahead", "first").alias("i")).union(used.select("path", F.explode("at").alias("i"))).union(inside).union(calls)
    # Dependencies count where both a source and a sink stand; else the first source or the sinks.
    both = facts.groupBy("path").agg((F.max("is_sink") & F.max("is_source")).alias("both"))
    alone = calls.union(sources.select("path", F.col("first").alias("i")))
    return kept.join(both.filter("both"), "path", "left_semi").union(alone.join(both.filter("not both"), "path", "left_semi")).distinct()


def compact_texts(docs: DataFrame) -> DataFrame:
    """(path, text, n_tokens) of documents (path, text) with kept lines: those lines, with a mark for each gap."""
    rows = lines(docs.select("path", "text")).withColumn("i", F.col("line") - 1).join(kept_lines(docs.select("path", "text")), ["path", "i"])
    gap = F.col("i") - F.row_number().over(Window.partitionBy("path").orderBy("i"))
    parts = rows.withColumn("gap", gap).groupBy("path", "gap").agg(F.min("i").alias("first"), F.array_sort(F.collect_list(F.struct("i", "code"))).alias("l"), F.sum(T.context_token_count(F.col("code"))).alias("n"))
    parts = parts.withColumn("block", F.regexp_replace(F.array_join(F.col("l.code"), "\n"), r"^\n+|\n+$", ""))
    whole = parts.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("first", "block"))).alias("b"), (F.sum("n") + OMITTED_TOKENS * (F.count("*") - 1)).alias("n_tokens"))
    return whole.select("path", F.array_join(F.col("b.block"), OMITTED).alias("text"), F.col("n_tokens").cast("long").alias("n_tokens"))
