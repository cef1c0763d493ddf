"""Journals as streams: usage counters, answers within a time bound, admission under a budget."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def timed(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Events with a watermark; local times are read in the session's zone, which must be UTC."""
    return events.withColumn("time", F.col("time").cast("timestamp")).withWatermark("time", delay)


def trial_counters(events: DataFrame, window: str = "1 day") -> DataFrame:
    """Starts, replies and tokens by stream and window of event time; late events within the watermark count."""
    is_ = lambda e: F.count_if(F.col("event") == e)
    return timed(events).groupBy(F.window("time", window).alias("w"), "stream").agg(is_("start").alias("starts"), is_("reply").alias("replies"), F.sum("tokens").alias("tokens")).select("stream", F.col("w.start").alias("begin"), "starts", "replies", "tokens")


def answered(starts: DataFrame, answers: DataFrame, within: str = "2 seconds") -> DataFrame:
    """Requests joined with answers of the same id in a time bound after them; both sides' state ends with the watermark."""
    a = starts.withColumn("asked", F.col("time").cast("timestamp")).withWatermark("asked", within).select("request_id", "asked")
    b = answers.withColumn("got", F.col("time").cast("timestamp")).withWatermark("got", within).select(F.col("request_id").alias("answer_id"), "got", "tokens")
    bound = (F.col("request_id") == F.col("answer_id")) & (F.col("got") >= F.col("asked")) & (F.col("got") <= F.col("asked") + F.expr(f"interval {within}"))
    return a.join(b, bound, "leftOuter").select("request_id", "asked", "got", "tokens")


def admitted(requests: DataFrame, limit: int) -> DataFrame:
    """Each stream's requests in order with whether its budget still admits them; the count is kept as state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0
        for pdf in batches:
            pdf = pdf.sort_values("seq")
            place = used + 1 + pd.RangeIndex(len(pdf)).to_numpy()
            used += len(pdf)
            yield pd.DataFrame({"stream": key[0], "seq": pdf["seq"], "admitted": place <= limit})
        state.update((used,))

    return requests.groupBy("stream").applyInPandasWithState(step, "stream long, seq long, admitted boolean", "used long", "append", GroupStateTimeout.NoTimeout)
