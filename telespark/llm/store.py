"""Intermediate tables in the shared checkpoint folder.

Row ids and partition numbers are only ever assigned in the job that writes a
stored table: a re-run scan may be split differently (an executor less, another
split size), a stored table never changes.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def folder(spark: SparkSession, label: str) -> str:
    """A fresh folder name under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{label}-{uuid.uuid4().hex}"


# rows Spark hands to Python at once: of whole texts, its own 10,000 can be a GB
ARROW_ROWS = 1_000


@contextmanager
def arrow_rows(spark: SparkSession, rows: int = ARROW_ROWS):
    """At most `rows` rows in an Arrow batch while a job runs; the session's setting returns."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it again: the lineage
    ends there, and a lost executor only costs its own tasks."""
    spark = df.sparkSession
    path = folder(spark, label)
    with arrow_rows(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._llm_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by `stash` that no later step reads."""
    spark = df.sparkSession
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._llm_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# narrow rows (up to 40 bytes): at most 40 MB
BROADCAST_ROWS = 1_000_000


def small(stashed: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored narrow table, marked for broadcast if it has at most `rows` rows; a larger
    one is joined by a shuffle."""
    return F.broadcast(stashed) if stashed.count() <= rows else stashed


# --- memory of Python workers -----------------------------------------------------------
# Spark keeps worker processes from task to task and from job to job.

_held: dict = {}


def held(key: str, make: Callable):
    """An object that a worker process keeps for the next task of the same operator."""
    if key not in _held:
        _held[key] = make()
    return _held[key]


def begin_task(key: str | None) -> None:
    """What another operator's tasks left in this process goes."""
    for other in [k for k in _held if k != key]:
        del _held[other]


def end_task() -> None:
    """Free pages go back to the system: an idle worker keeps none."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)     # glibc
    if trim:
        trim(0)


def tidy(run: Callable, key: str | None = None) -> Callable:
    """A function for mapInArrow that leaves its worker process small when a task ends;
    only what it holds under `key` stays."""
    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task(key)
        try:
            yield from run(batches)
        finally:
            end_task()
    return tasks
