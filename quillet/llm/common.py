"""Staging tables, document views and 64-bit mixing shared by the operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import new_path, stage, swept, unstage  # noqa: F401


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under our own names, so extra or clashing columns of the input never meet ours."""
    return df.select(*[df[c].alias(name) for name, c in columns.items()])


def release(spark: SparkSession) -> None:
    """Let the driver drop what no plan refers to; the context cleaner then deletes those shuffle files."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def parts_for(spark: SparkSession, rows: int, per_part: int) -> int:
    """Partitions for so many rows; at least the session's setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_part))


def small_batches(spark: SparkSession, limit: int = 4 << 20) -> None:
    """Let Python workers of this session take texts in batches of few bytes: long texts must not pile up by their number.

    A setting other than Spark's own stays; a longer row is a batch by itself.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, str(limit))


def give_back() -> None:
    """Let this Python worker return what Arrow and the C library hold unused: workers live on beside the JVM and later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, for mapInArrow, giving memory back after each batch of its results and at its end."""

    def held(batches):
        for b in run(batches):
            yield b
            del b
            give_back()
        give_back()

    return held


U = np.uint64
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit words (splitmix finaliser)."""
    x = x + U((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


def texts_of(column) -> list[str]:
    """Arrow strings as Python strings; null counts as empty."""
    return [x or "" for x in column.to_pylist()]
