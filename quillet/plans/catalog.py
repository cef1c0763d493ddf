"""Queries over the driver's tables by name; oracles.py has their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexical
from ..functions import text as T
from ..operators import accept, context, graph, journal, locate, metrics, retrieval, rules, votes
from ..sources import readers
from ..sources.staging import new_path, stage
from ..streaming import journal as streaming_journal
from . import bindings as B
from . import code_catalog, evidence_catalog, flow_catalog, run_catalog
from .oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]
QUERIES: dict = code_catalog.QUERIES | evidence_catalog.QUERIES | run_catalog.QUERIES | flow_catalog.QUERIES
ORACLES |= code_catalog.ORACLES | evidence_catalog.ORACLES | run_catalog.ORACLES | flow_catalog.ORACLES


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


@query
def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = B.code_documents(spark, sf_dir)
    return _rounded(retrieval.inverse_frequency(retrieval.terms(docs, "path", F.col("text")), docs), "idf")


@query
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each benchmark item the five best documents, by their path, defined symbols (here their language) and text; the item's path and text ask."""
    own, asked = F.concat_ws(" ", "path", "lang", "text"), F.concat_ws(" ", F.concat(F.lit("bench/item"), F.col("query_id").cast("string")), "query")
    return retrieval.top_k(retrieval.bm25(B.code_documents(spark, sf_dir), B.queries_table(spark, sf_dir), own, asked), 5)


@query
def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each benchmark item the five best documents by their text, and by their path where the item looks like one."""
    scored = retrieval.tfidf(B.code_documents(spark, sf_dir), B.queries_table(spark, sf_dir), F.col("text"), F.col("query"), F.col("query").rlike(retrieval.PATH_LIKE))
    return retrieval.top_k(scored, 5)


@query
def path_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by queries that name paths: the whole path, a directory, a file with a suffix, words."""
    docs = B.code_documents(spark, sf_dir).withColumn("path", F.concat("path", F.lit(".py")))
    asked = B.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"), F.concat(F.when(F.col("n_nationkey") % 3 == 0, "Src").when(F.col("n_nationkey") % 3 == 1, "see en/").otherwise("the license "), F.col("n_nationkey").cast("string"), F.when(F.col("n_nationkey") % 2 == 0, ".py.").otherwise("/en")).alias("query"))
    return retrieval.top_k(retrieval.tfidf(docs, asked, F.col("text"), F.col("query"), F.col("query").rlike(retrieval.PATH_LIKE)), 8)


@query
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence of bm25_topk under a budget of 2,000 tokens a query."""
    found = stage(bm25_topk(spark, sf_dir), "found").join(B.code_documents(spark, sf_dir).select("path", "text"), "path")
    return retrieval.limit_budget(found, 2000).select("query_id", "rank", "path", F.col("n_tokens").cast("long").alias("n_tokens"))


@query
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.hybrid([bm25_topk(spark, sf_dir), tfidf_topk(spark, sf_dir)], 8)


@query
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders call suppliers and brands by name; a name that several documents define links to none."""
    part, supplier, li = (B.table(spark, sf_dir, t) for t in ("part", "supplier", "lineitem"))
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias("path")
    defines = part.select(key("p", "p_partkey"), F.col("p_brand").alias("symbol")).union(supplier.select(key("s", "s_suppkey"), "s_name"))
    calls = li.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return graph.build_edges(calls.select(key("o", "l_orderkey"), F.explode(F.array("p_brand", "s_name")).alias("symbol")), defines)


@query
def graph_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every region against the edges, three hops."""
    seeds = B.table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("path"))
    return graph.distances(seeds, graph.reverse(B.edges(spark, sf_dir)), 3)


@query
def graph_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph_bfs(spark, sf_dir).select(F.col("seed").alias("query_id"), "path", "distance", F.lit(None).cast("double").alias("lexical"))
    return retrieval.graph_rank(found, 12).select("query_id", "path", "distance", "score", "rank")


@query
def reply_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that a turn follows, eight at most: each turn depends on the one before."""
    c = B.table(spark, sf_dir, "conversations").filter("turn > 0")
    name = lambda t: F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string"))
    return graph.closure(c.select(name(F.col("turn")).alias("src"), name(F.col("turn") - 1).alias("dst")), 8)


@query
def quorum_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(votes.majority(votes.checked(B.votes(spark, sf_dir))), "confidence")


@query
def quorum_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(votes.early(votes.checked(B.votes(spark, sf_dir))), "confidence")


@query
def single_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.single(B.votes(spark, sf_dir))


@query
def last_ballots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.last_ballots(B.executions(spark, sf_dir))


@query
def quorum_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.prefix_replay(B.executions(spark, sf_dir), ("scan", "taint", "authz"), 2)


@query
def cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.cost_rollup(B.executions(spark, sf_dir))


@query
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.predictions(spark, sf_dir).filter("system = 'V1'").withColumn("predicted", F.col("label") == "VULNERABLE")
    return metrics.binary(rows, "category")


@query
def ternary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ternary(B.predictions(spark, sf_dir), "system")


@query
def failure_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.failure_aware(B.results(spark, sf_dir), "system"), "recall_low", "recall_high", "fpr_low", "fpr_high")


@query
def wilson_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of English documents in each source."""
    c = B.table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("lang") == "en").alias("success"))
    return _rounded(c.select("source", "success", "total", T.wilson(F.col("success"), F.col("total")).alias("w")).select("source", "success", "total", "w.low", "w.high"), "low", "high")


@query
def paired_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.paired(B.results(spark, sf_dir), "E1", "E2")


@query
def label_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.transitions(B.predictions(spark, sf_dir), "V1", "V3")


@query
def subset_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.subset_report(B.predictions(spark, sf_dir))


@query
def rule_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents under three rules for prose."""
    found = {"long-number": "[0-9]{6,}", "assignment": r"\b(?:token|password|secret)\s*=", "mail": "[A-Za-z0-9.]+@[A-Za-z0-9.]+"}
    return rules.hits(B.table(spark, sf_dir, "documents").select("doc_id", "text"), found).select("doc_id", "line", "rule")


@query
def rule_smallest_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each first line of a span and symbol, the smallest span of that symbol around it."""
    s = B.spans(spark, sf_dir)
    around = s.select("file", F.col("first").alias("source_line")).join(s, "file").filter("first <= source_line and source_line <= last")
    found = around.select("file", "source_line", F.col("symbol").alias("rule"), "path", (F.col("last") - F.col("first")).alias("n_lines"), F.col("path").endswith("0").alias("is_module"))
    return rules.smallest_span(found).select("file", "source_line", "rule", "path")


@query
def span_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locate.enclosing_span(B.points(spark, sf_dir), B.spans(spark, sf_dir))


@query
def nearest_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locate.candidate_document(B.points(spark, sf_dir), B.spans(spark, sf_dir))


@query
def merged_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locate.merged_ranges(B.spans(spark, sf_dir), "file")


@query
def discovery_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, labels = B.table(spark, sf_dir, "documents"), B.table(spark, sf_dir, "labels")
    place = [F.col("source").alias("repo"), F.col("lang").alias("commit"), F.col("n_chars").alias("file")]
    candidates = d.select(F.col("doc_id").alias("case_id"), *place, (F.col("doc_id") % 9).alias("line"))
    references = labels.join(d, "doc_id").select(F.col("doc_id").alias("entry_id"), *place, ((F.col("doc_id") + F.col("toxic")) % 9).alias("line"), (F.col("doc_id") % 50).alias("report_id"))
    return locate.discovery_report(candidates, B.results(spark, sf_dir), references)


@query
def planned_vs_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = B.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), F.col("lang").alias("truth"))
    seen = B.results(spark, sf_dir).filter("status <> 'not_run'").withColumn("calls", F.col("model_calls"))
    return accept.with_plan(seen, accept.planned_cells(cases, ["E1", "E3"]))


@query
def acceptance_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = F.when(F.col("n_chars") % 2 == 0, "VULNERABLE").otherwise("SAFE").alias("truth")
    cases = B.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), truth)
    rows = B.results(spark, sf_dir).withColumnRenamed("predicted_label", "label")
    return accept.acceptance_issues(rows, accept.planned_cells(cases, ["E1"]))


@query
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three documents of each language (the sample is the feature)."""
    d = B.table(spark, sf_dir, "documents").select("doc_id", "lang", "source").filter("lang is not null")
    return accept.stratified_sample(d, 3, ["lang"], F.col("doc_id").cast("string"), "quillet-sample-1:").select("doc_id", "lang", "source", "place")


@query
def heldout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accept.heldout(B.entries(spark, sf_dir), spark.createDataFrame([("src0",), ("src7",)], "repo string"))


@query
def subject_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accept.largest_group(B.entries(spark, sf_dir).filter("verified"), "repo", "commit")


@query
def dataset_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.entries(spark, sf_dir).agg(F.count("*").alias("entries"), F.count_if("verified").alias("verified"), F.count_distinct("report_id").alias("reports"), F.count_distinct("repo").alias("repos"), F.count_distinct("repo", "commit").alias("commits"))


@query
def key_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accept.key_differences(B.table(spark, sf_dir, "documents"), B.table(spark, sf_dir, "labels"), "doc_id")


@query
def usage_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.tagged_usage(B.journal(spark, sf_dir))


@query
def usage_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.stream_usage(B.journal(spark, sf_dir))


@query
def in_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.in_flight(B.journal(spark, sf_dir))


@query
def transport_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.unanswered(B.journal(spark, sf_dir))


@query
def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.run_totals(B.journal(spark, sf_dir))


@query
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each page, as for commit links of an advisory: all, distinct, and the first."""
    pages = B.table(spark, sf_dir, "pages").select("page_id", F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)).alias("h"))
    return pages.select("page_id", F.size("h").alias("links"), F.size(F.array_distinct("h")).alias("distinct_links"), F.get("h", F.lit(0)).alias("first_link"))


@query
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without tags, white space collapsed."""
    return B.table(spark, sf_dir, "pages").select("page_id", T.collapsed(F.regexp_replace("html", "<[^>]*>", " ")).alias("text"))


@query
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(T.tokenize(F.col("text"))).alias("identifiers"), T.context_token_count(F.col("text")).alias("context_tokens"), T.byte_bound(F.col("text")).alias("byte_bound"))


@query
def retained_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders all of whose suppliers stay when small lines go."""
    li = B.table(spark, sf_dir, "lineitem")
    required = li.select("l_orderkey", "l_suppkey").distinct()
    return accept.covers(required, li.filter("l_quantity >= 10"), "l_orderkey", "l_suppkey")


@query
def repair_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer the first finished order, by order key, and how many come before it."""
    o = B.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entry_id"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("commit"), (F.col("o_orderstatus") == "F").alias("accepted"))
    return accept.repair_choice(o).withColumnRenamed("entry_id", "o_custkey")


@query
def usage_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts, replies and tokens of each stream and day, from the events read as a stream to its end."""
    path = new_path(spark, "usage")
    schema = B.table(spark, sf_dir, "events").schema
    raw = readers.stream_parquet(spark, f"{sf_dir}/events.parquet", schema)
    counters = streaming_journal.trial_counters(B.as_journal(raw))
    run = counters.writeStream.outputMode("complete").option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    run.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{path}/rows")).start().awaitTermination()
    return spark.read.parquet(f"{path}/rows").withColumn("begin", F.date_format("begin", "yyyy-MM-dd"))


@query
def augmentation_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a budget of 1,488 tokens is dealt over the evidence of each benchmark item."""
    return context.shares(bm25_topk(spark, sf_dir).select("query_id", "path", "rank"), 1488)


@query
def fallback_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files of an unknown language: their calls and definitions by patterns, counted."""
    files = B.table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").alias("text"), F.lit("unknown").alias("language"))
    return lexical.fallback_documents(files).select("file", F.size("calls").alias("calls"), F.array_join("calls", ",").alias("names"))
