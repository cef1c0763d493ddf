"""Tables staged in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a single machine one of our own where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="quillet-"))
    return _own_dir[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quillet-{uuid.uuid4().hex}/{name}"


@contextlib.contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Writes in this block delete their shuffle files when they end, since later plans start from what they wrote."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later plans start from files that survive lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    with swept(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes in memory that a byte of a staged file may stand for, where rows repeat names.
EXPANDED = 64


def stage_facts(df: DataFrame, name: str) -> DataFrame:
    """stage() for rows whose names repeat: files are a small part of their rows' size.

    Spark takes a file's size for that of its rows, and would send tables to the driver and all tasks that are far
    larger. While this table is planned and written, files count as EXPANDED times their size; what is small as it
    runs may still be sent, by its measured size.
    """
    key, conf = "spark.sql.sources.fileCompressionFactor", df.sparkSession.conf
    before = conf.get(key)
    conf.set(key, str(max(float(before), float(EXPANDED))))
    try:
        # Planned anew from its own nodes: sizes that were looked at under another setting don't count.
        return stage(df.select("*"), name)
    finally:
        conf.set(key, before)


def unstage(*dfs: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in dfs:
        spark = df.sparkSession
        for f in df.inputFiles()[:1]:
            p = spark._jvm.org.apache.hadoop.fs.Path(f).getParent()
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
