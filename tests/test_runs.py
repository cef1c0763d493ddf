"""Runs and streams that stop half way and are taken up again."""

import pytest
from pyspark.sql import functions as F

from quillet.sources.runs import Run, follow
from quillet.sources.staging import new_path


def test_a_run_taken_up_again(spark):
    path = new_path(spark, "run")
    plan = spark.createDataFrame([(i, s) for i in range(10) for s in "ab"], "case_id int, system string")
    manifest = spark.createDataFrame([("m", 1), ("n", 2)], "name string, size int")
    content, done = F.concat_ws(":", "name", "size"), plan.withColumn("label", F.lit("SAFE"))
    run = Run(spark, path)
    assert run.begin(manifest=(manifest, content)) is False and run.remaining(plan, ["case_id", "system"], done.schema).count() == 20
    run.record(done.filter("case_id < 4"), 0)
    again = Run(spark, path)
    assert again.begin(manifest=(manifest.repartition(3), content)) is True
    left = again.remaining(plan, ["case_id", "system"], done.schema)
    assert {r["case_id"] for r in left.collect()} == set(range(4, 10))
    again.record(done.join(left, ["case_id", "system"]).select(*done.columns), 1)
    again.record(done.filter("case_id < 4"), 0)
    assert sorted(map(tuple, again.finished(done.schema).collect())) == sorted(map(tuple, done.collect()))
    assert again.remaining(plan, ["case_id", "system"], done.schema).count() == 0
    with pytest.raises(ValueError, match="manifest changed"):
        Run(spark, path).begin(manifest=(manifest.limit(1), content))
    with pytest.raises(ValueError, match="other"):
        Run(spark, path).begin(manifest=(manifest, content), other=(manifest, content))
    assert Run(spark, new_path(spark, "empty")).begin(manifest=(manifest.limit(0), content)) is False


def test_a_stream_that_fails_and_goes_on(spark):
    """A batch that fails behind its write is tried again and counted once; the sums are those of an undisturbed stream."""
    source, rows = new_path(spark, "in"), [(i % 3, i) for i in range(300)]
    for part in range(6):
        spark.createDataFrame(rows[part * 50 : part * 50 + 50], "k int, v long").coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema("k int, v long").option("maxFilesPerTrigger", 1).parquet(source)
    calls = []

    def summary(df):
        calls.append(1)
        out = df.groupBy("k").agg(F.sum("v").alias("total"), F.count("*").alias("n"))
        if len(calls) == 3:
            # The batch fails once its sums are half written.
            return out.withColumn("n", F.when(F.col("k") == 1, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("n")))
        return out

    path = new_path(spark, "progress")
    with pytest.raises(Exception, match="lost"):
        follow(stream(), path, summary, ["k"])
    got = sorted(map(tuple, follow(stream(), path, summary, ["k"]).select("k", "total", "n").collect()))
    assert got == [(k, sum(v for a, v in rows if a == k), 100) for k in range(3)] and len(calls) == 7
    assert sorted(map(tuple, follow(stream(), path, summary, ["k"]).select("k", "total", "n").collect())) == got
