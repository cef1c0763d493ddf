"""The engine's tables over the driver's tables; each view has the same SQL form in oracles.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import accept

#: Documents that a task makes files of, and parses: far more work than their few columns' size says.
PER_TASK = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_chars) of all documents, dealt anew: a stored table may be one piece, and would be one task."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return rows.repartition(rows.count() // PER_TASK + 1)


def code_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text, source, lang): documents under source/lang/id."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text", "source", "lang", "doc_id", "n_chars")


def queries_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _pick(n, *names: str):
    return F.element_at(F.array(*[F.lit(x) for x in names]), (n + 1).cast("int"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three experts' votes on each document, by fixed rules on its size and id."""
    d = table(spark, sf_dir, "documents")
    rules = [("scan", F.col("n_chars") % 3, F.col("n_chars") % 11), ("taint", F.expr("n_chars div 3") % 3, F.col("doc_id") % 11), ("authz", (F.col("doc_id") * 7 + 1) % 3, F.expr("n_chars div 5") % 11)]
    each = [F.struct(F.lit(e).alias("expert"), _pick(say, "VULNERABLE", "SAFE", "ABSTAIN").alias("label"), ((50 + sure * 5) / F.lit(100.0)).alias("confidence"), F.lit(i).alias("vote_order")) for i, (e, say, sure) in enumerate(rules)]
    return d.select(F.col("doc_id").alias("case_id"), F.inline(F.array(*each)))


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task executions: each turn of a conversation is a task of an expert, in turn order, with a judgement and its cost."""
    c = table(spark, sf_dir, "conversations")
    size = F.length("text")
    return c.select(F.col("conv_id").alias("case_id"), F.col("turn").alias("position"), _pick((F.col("turn") + F.col("conv_id")) % 3, "scan", "taint", "authz").alias("expert"), _pick(size % 3, "VULNERABLE", "SAFE", "ABSTAIN").alias("label"), ((50 + size % 11 * 5) / F.lit(100.0)).alias("confidence"), (size % 7).cast("long").alias("calls"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with the label of three systems (case_id, system, actual, label, category, is_primary)."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    rows = accept.planned_cells(rows, ["V1", "V2", "V3"])
    n = F.col("n_chars") + F.col("doc_id") * F.substring("system", 2, 1).cast("int")
    return rows.select(F.col("doc_id").alias("case_id"), "system", (F.col("quality") == 1).alias("actual"), _pick(n % 5, "VULNERABLE", "SAFE", "VULNERABLE", "SAFE", "ABSTAIN").alias("label"), F.col("lang").alias("category"), F.col("lang").isin("en", "de").alias("is_primary"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows of two systems over labelled documents (case_id, system, status, predicted_label, ground_truth, model_calls, tool_calls)."""
    rows = accept.planned_cells(table(spark, sf_dir, "labels"), ["E1", "E2"])
    k = F.substring("system", 2, 1).cast("int")
    status = _pick((F.col("doc_id") * k) % 13, "failed", "not_run", "abstained", *["completed"] * 10)
    label = F.when(status == "completed", F.when((F.col("doc_id") + k) % 4 != 0, "VULNERABLE").otherwise("SAFE"))
    truth = F.when(F.col("quality") == 1, "VULNERABLE").otherwise("SAFE")
    return rows.select(F.col("doc_id").alias("case_id"), "system", status.alias("status"), label.alias("predicted_label"), truth.alias("ground_truth"), (F.col("doc_id") % 5).alias("model_calls"), (F.col("doc_id") % 3).alias("tool_calls"))


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a journal (seq, time, stream, event, request_id, tokens)."""
    return as_journal(table(spark, sf_dir, "events"))


def as_journal(e: DataFrame) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for pair in (("click", "start"), ("view", "received"), ("purchase", "reply"), ("signup", "invalid"), ("error", "error")) for x in pair])
    return e.select(F.col("event_id").alias("seq"), F.col("ts").alias("time"), (F.col("user_id") % 20).alias("stream"), F.try_element_at(kind, "event_type").alias("event"), (F.col("event_id") % 3000).cast("string").alias("request_id"), F.get_json_object("props", "$.k").cast("long").alias("tokens"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part -> supplier -> nation -> region, by prefixed keys."""
    li, s, n = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation"))
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    out = li.select(key("p", "l_partkey").alias("src"), key("s", "l_suppkey").alias("dst")).distinct()
    return out.union(s.select(key("s", "s_suppkey"), key("n", "s_nationkey"))).union(n.select(key("n", "n_nationkey"), key("r", "n_regionkey")))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as spans of lines of a file, their source (file, path, symbol, first, last)."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("file"), F.col("doc_id").cast("string").alias("path"), F.col("lang").alias("symbol"), F.col("doc_id").alias("first"), (F.col("doc_id") + F.expr("n_chars div 50")).alias("last"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as lines of their source (point_id, file, line, symbol)."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    return rows.select(F.col("doc_id").alias("point_id"), F.col("source").alias("file"), (F.col("doc_id") + F.col("n_chars") % 7).alias("line"), F.when(F.col("toxic") == 1, "fr").otherwise("none").alias("symbol"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as data set entries (entry_id, repo, commit, report_id, verified)."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("entry_id"), F.col("source").alias("repo"), F.concat(F.lit("c"), (F.col("n_chars") % 5).cast("string")).alias("commit"), (F.col("doc_id") % 97).alias("report_id"), (F.col("n_chars") % 4 != 0).alias("verified"))
