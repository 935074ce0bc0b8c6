"""Session helpers for tests and the bench.

The library itself never builds a session: every operator receives DataFrames.
On a cluster the session (and `spark.checkpoint.dir`) come from the deployment;
these helpers only fill in values that are unset, which is the local/test case.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

_LOCAL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "telespark") -> SparkSession:
    """A local session for tests and the bench (never used by operators)."""
    builder = SparkSession.builder.master(master or "local[*]").appName(app_name)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("TELESPARK_DRIVER_MEMORY", "8g"))
    for key, value in _LOCAL_DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder the cluster names, if any."""
    value = spark.conf.get("spark.checkpoint.dir", None)
    if value:
        return value
    return spark.sparkContext.getCheckpointDir()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the configured `spark.checkpoint.dir`; set a scratch one only when unset
    and the master is local.

    On a cluster the setting must point at shared storage (a machine-local folder
    would not survive executor loss); without it this raises instead of guessing.
    Only local runs (tests, bench) without it get a fresh folder under the temp dir.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if configured:
        if not current:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to shared storage (e.g. an HDFS or object-store "
                           "path): telespark cuts lineage with reliable checkpoints there")
    folder = tempfile.mkdtemp(prefix="telespark-ckpt-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df):
    """Cut the lineage of a derived table that several branches (or a size check
    and the query itself) read: a reliable checkpoint into `spark.checkpoint.dir`
    (shared storage on a cluster, so it survives executor loss). With
    spark.cleaner.referenceTracking.cleanCheckpoints Spark deletes its files once no
    DataFrame refers to them."""
    ensure_checkpoint_dir(df.sparkSession)
    # the write job after the eager count reuses the count job's shuffle outputs,
    # so only the last stage runs twice; no cache is needed for it
    return df.checkpoint(eager=True)


def stored(df):
    """A derived table written once as parquet into `spark.checkpoint.dir` and read back.
    A checkpoint computes its last stage twice and keeps whole rows; this one is for tables
    that grow with the input. `discard` deletes it when no later step reads it."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/telespark-steps/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def discard(df) -> None:
    """Delete a table made by `stored`."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


TASK_ROWS = 500_000         # rows that one task of a shuffle should sort


@contextmanager
def tasks_for(spark: SparkSession, rows: int, task_rows: int = TASK_ROWS):
    """Shuffles of the jobs run inside have a partition per `task_rows` rows, if the session's
    setting gives fewer: what a task sorts does not grow with the input. The setting returns."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    wanted = rows // task_rows + 1
    if wanted > int(before):
        spark.conf.set(key, str(wanted))
    try:
        yield
    finally:
        spark.conf.set(key, before)
