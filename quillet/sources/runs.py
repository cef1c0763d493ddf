"""Runs that can be stopped and taken up again: what they are made from is fixed by digests, what they have done is kept in batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.identity import tree_digest


class Run:
    """A run in a shared folder: `identity` holds the digests it began with, `cells` its finished cells, a folder for each batch.

    A batch is written over what an earlier try of it left, so repeating one changes nothing. Batches are written by
    tasks; the driver holds two digests. A run is its folder's: two writers of one batch are not told apart.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, name: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def begin(self, **tables: tuple[DataFrame, Column]) -> bool:
        """Start the run, or take it up: then every table (with the content that counts of its rows) must have the digest that it began with. True for a run taken up."""
        now = {}
        for name, (rows, content) in sorted(tables.items()):
            found = tree_digest(rows, content).first()
            now[name] = (found["digest"], found["rows"]) if found else ("", 0)
        if self._exists("identity"):
            before = {r["name"]: (r["digest"], r["rows"]) for r in self.spark.read.parquet(f"{self.path}/identity").collect()}
            if changed := sorted(n for n in {*before, *now} if before.get(n) != now.get(n)):
                raise ValueError(f"{', '.join(changed)} changed since the run began")
            return True
        rows = [(n, d, k) for n, (d, k) in now.items()]
        self.spark.createDataFrame(rows, "name string, digest string, rows long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/identity")
        return False

    def record(self, rows: DataFrame, batch: int) -> None:
        """Keep finished cells as a batch, in place of what an earlier try of the batch kept."""
        rows.write.mode("overwrite").parquet(f"{self.path}/cells/batch={batch}")

    def finished(self, schema: StructType) -> DataFrame:
        """All finished cells; none before the first batch has ended."""
        found = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/cells")
        if not found.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(found):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/cells").parquet(f"{self.path}/cells/batch=*").select(*schema.names)

    def remaining(self, cells: DataFrame, key: list[str], schema: StructType) -> DataFrame:
        """The planned cells that are not finished."""
        return cells.join(self.finished(schema).select(*key).distinct(), key, "left_anti")


def follow(events: DataFrame, path: str, summary: Callable[[DataFrame], DataFrame], key: list[str]) -> DataFrame:
    """The sums of a stream's events by key, kept up to date in a folder: (key..., counters...).

    Each batch of the stream leaves its own sums under its number, so a batch that is tried again after a failure
    replaces what it left and is counted once; stopped and started again, the stream goes on behind its last batch.
    summary makes (key..., counters...) of a batch's events; counters are added up over batches. Ends with the stream.
    """
    spark, path = events.sparkSession, path.rstrip("/")
    keep = lambda df, batch: summary(df).write.mode("overwrite").parquet(f"{path}/sums/batch={batch}")
    run = events.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(keep).start()
    run.awaitTermination()
    rows = spark.read.option("basePath", f"{path}/sums").parquet(f"{path}/sums/batch=*").drop("batch")
    return rows.groupBy(*key).agg(*[F.sum(c).alias(c) for c in rows.columns if c not in key])
