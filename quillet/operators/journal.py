"""Accounting over an event journal (seq, time, stream, event, request_id, tokens)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def tagged_usage(events: DataFrame) -> DataFrame:
    """One row for events with request ids: requests, responses, invalid ones, duplicate starts, orphans, token subtotal, unknown and conflicting usage.

    A request's tokens count when its events agree on exactly one total; what the receive events say goes first.
    """
    is_ = lambda e: F.col("event") == e
    known = F.col("tokens") >= 0
    got = F.collect_set(F.when(is_("received") & known, F.col("tokens")))
    late = F.collect_set(F.when((is_("reply") | is_("invalid")) & known, F.col("tokens")))
    each = events.filter("request_id is not null").groupBy("request_id").agg(
        F.count_if(is_("start")).alias("starts"), F.count_if(is_("reply")).alias("replies"), F.count_if(is_("invalid")).alias("invalid"), F.count_if(is_("received")).alias("received"),
        got.alias("got"), late.alias("late"),
    )
    each = each.withColumn("totals", F.when(F.col("received") > 0, F.col("got")).otherwise(F.col("late")))
    live, one = F.col("starts") > 0, F.size("totals") == 1
    return each.agg(
        F.count_if(live).alias("requests"), F.count_if(live & (F.col("replies") > 0)).alias("responses"), F.count_if(live & (F.col("invalid") > 0)).alias("invalid"),
        F.sum(F.when(live, F.col("starts") - 1).otherwise(0)).alias("duplicate_starts"), F.count_if(~live & (F.col("received") + F.col("replies") > 0)).alias("orphans"),
        F.sum(F.when(live & one, F.element_at("totals", 1)).otherwise(0)).alias("tokens"), F.count_if(live & ~one).alias("unknown"), F.count_if(live & (F.size("totals") > 1)).alias("conflicts"),
    )


def stream_usage(events: DataFrame) -> DataFrame:
    """Usage of journals without request ids, by stream: a reply counts only if nothing was received since its stream's last start."""
    order = Window.partitionBy("stream").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("epoch", F.sum(F.when(F.col("event") == "start", 1).otherwise(0)).over(order))
    before = Window.partitionBy("stream", "epoch").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("had", F.coalesce(F.max(F.when(F.col("event") == "received", 1).otherwise(0)).over(before), F.lit(0)))
    counts = (F.col("event") == "received") | (F.col("event").isin("reply", "invalid") & (F.col("had") == 0))
    known = counts & (F.col("tokens") >= 0)
    return rows.groupBy("stream").agg(F.count_if(F.col("event") == "start").alias("requests"), F.sum(F.when(known, F.col("tokens")).otherwise(0)).alias("tokens"), (F.count_if(F.col("event") == "start") - F.count_if(known)).alias("unknown"))


def in_flight(events: DataFrame) -> DataFrame:
    """By stream the highest and the last number of requests begun but not ended, and the seconds from first to last event."""
    step = F.when(F.col("event") == "start", 1).when(F.col("event").isin("reply", "error"), -1).otherwise(0)
    running = F.sum(step).over(Window.partitionBy("stream").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    rows = events.withColumn("running", running)
    span = F.unix_timestamp(F.max("time").cast("timestamp")) - F.unix_timestamp(F.min("time").cast("timestamp"))
    return rows.groupBy("stream").agg(F.max("running").alias("peak"), F.max_by("running", "seq").alias("final"), span.alias("seconds"))


def unanswered(events: DataFrame) -> DataFrame:
    """Requests (request_id, starts) that began and have no answer of any kind."""
    begun = events.filter("event = 'start' and request_id is not null").groupBy("request_id").agg(F.count("*").alias("starts"))
    return begun.join(events.filter("event in ('reply', 'received')").select("request_id"), "request_id", "left_anti")


def run_totals(events: DataFrame) -> DataFrame:
    """Events and tokens by stream and over all streams (null); unknown tokens make a total null rather than zero."""
    total = F.when(F.count_if(F.col("tokens").isNull()) == 0, F.sum("tokens"))
    return events.rollup("stream").agg(F.count("*").alias("events"), total.alias("tokens"))
