"""Sinks: appended journals, frozen artifacts, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_journal(events: DataFrame, path: str) -> None:
    """Events as JSON lines, each with the time it was written; the commit protocol makes an append whole or absent."""
    events.withColumn("written", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")).write.mode("append").json(path)


def write_frozen(df: DataFrame, path: str) -> bool:
    """Write a table once. The same rows again are no change (False); other rows are an error."""
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        df.write.mode("errorifexists").parquet(path)
        return True
    held = spark.read.parquet(path)
    if sorted(held.columns) != sorted(df.columns):
        raise ValueError(f"{path} is frozen with other columns")
    held = held.select(*df.columns)
    if not (held.exceptAll(df).isEmpty() and df.exceptAll(held).isEmpty()):
        raise ValueError(f"{path} is frozen with other rows")
    return False


def canonical_json(df: DataFrame) -> DataFrame:
    """One column `json`: each row with its fields in the order of their names."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])).alias("json"))


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A summary table as Markdown; a table of more than `limit` rows is no summary, and an error."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report holds at most {limit} rows")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)])
