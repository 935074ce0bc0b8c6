"""Evidence export and its index (O-06, O-07, O-08)."""

from __future__ import annotations

import uuid
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import scoring


class EvidenceExists(RuntimeError):
    """Raised instead of overwriting exported evidence."""


def _path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def existing_incidents(spark: SparkSession, path: str, run_id: str) -> list:
    """Incident partitions already exported for this run (directory listing only)."""
    run_dir = f"{path.rstrip('/')}/run_id={quote(run_id, safe='')}"
    if not _path_exists(spark, run_dir):
        return []
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(run_dir)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(unquote(st.getPath().getName().split("=", 1)[1]) for st in fs.listStatus(p)
                  if st.isDirectory() and st.getPath().getName().startswith("incident_id="))


def _leaves(fs, folder, depth: int):
    """Partition folders `depth` levels below."""
    for st in fs.listStatus(folder):
        if st.isDirectory() and "=" in st.getPath().getName():
            yield from [st.getPath()] if depth == 1 else _leaves(fs, st.getPath(), depth - 1)


def _rename(fs, source, target) -> None:
    fs.mkdirs(target.getParent())
    if not fs.rename(source, target):
        raise IOError(f"cannot move {source} to {target}")


def publish_partitions(rows: DataFrame, path: str, by: list[str]) -> list[str]:
    """Write `rows` partitioned by the columns `by` under `path`: all partitions or none.

    The job writes to a hidden folder under `path`, which readers skip; a failed job leaves
    what is there untouched. Then each partition is moved into place by a rename, the one
    it replaces is set aside first; if a move fails, those done are undone. (Where a rename
    is a copy, as in some object stores, the moves take as long as copying.) Returns the
    partitions written, relative to `path`.
    """
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    staging = f"{path.rstrip('/')}/.staging-{uuid.uuid4().hex}"
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    moved = []
    try:
        rows.write.partitionBy(*by).parquet(f"{staging}/new")
        root = fs.makeQualified(at(f"{staging}/new")).toString()
        names = [p.toString()[len(root) + 1:] for p in _leaves(fs, at(f"{staging}/new"), len(by))]
        try:
            for name in names:
                new, old, target = (at(p) for p in (f"{staging}/new/{name}", f"{staging}/old/{name}", f"{path}/{name}"))
                if fs.exists(target):
                    _rename(fs, target, old)
                    moved.append((old, target))
                _rename(fs, new, target)
                moved.append((target, new))
        except Exception:
            for source, target in reversed(moved):       # back the way they came
                _rename(fs, source, target)
            raise
        return names
    finally:
        fs.delete(at(staging), True)


def export_traces(spans: DataFrame, incidents: DataFrame, path: str, run_id: str,
                  root_service: str = "gateway", force: bool = False) -> DataFrame:
    """Write the spans of every trace whose root starts inside an incident window (the
    confirmed bounds where a label has them), partitioned by (run_id, incident_id).
    Returns the evidence index.

    Refuses when any partition of this run exists, unless `force`; with `force`
    only the partitions being written are replaced, so an incident that yields no
    traces keeps its earlier export and is never replaced by an empty one. The
    partitions appear when all of them are written (see `publish_partitions`).
    """
    spark = spans.sparkSession
    have = existing_incidents(spark, path, run_id)
    if have and not force:
        raise EvidenceExists(f"{len(have)} export(s) already under {path} for {run_id}: {have}; "
                             f"pass force=True to replace them")
    traced = scoring.traces_in_windows(spans, incidents, root_service)
    rows = spans.join(traced.select("incident_id", "trace_id"), "trace_id").withColumn("run_id", F.lit(run_id))
    publish_partitions(rows, path, ["run_id", "incident_id"])
    return scoring.evidence_index(spans, incidents, root_service, traced)


def merge_index(old: DataFrame, new: DataFrame, files: DataFrame, labels: DataFrame) -> DataFrame:
    """Merge evidence index entries.

    Old entries survive only if their file still exists; new entries win by
    incident_id; rows follow the label order (labels: incident_id, pos), unknown
    incidents last (position null).
    """
    kept = old.join(files.select("file").distinct(), "file", "left_semi")
    merged = kept.join(new.select("incident_id"), "incident_id", "left_anti").unionByName(new)
    return (merged.join(labels.select("incident_id", "pos"), "incident_id", "left")
            .orderBy(F.col("pos").asc_nulls_last(), "incident_id"))


INDEX_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("jaeger_url", T.StringType()),
    T.StructField("limit", T.IntegerType()),
    T.StructField("incidents", T.ArrayType(T.StructType([
        T.StructField("incident_id", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("root_service", T.StringType()),
        T.StructField("window", T.StructType([T.StructField("start", T.StringType()),
                                              T.StructField("end", T.StringType())])),
        T.StructField("traces", T.IntegerType()),
        T.StructField("spans", T.IntegerType())]))),
])


def read_evidence_index(spark: SparkSession, path: str) -> DataFrame:
    """Evidence index documents -> one row per incident entry (window bounds as µs)."""
    from ..functions.time import parse_iso_strict
    doc = spark.read.schema(INDEX_SCHEMA).option("multiLine", True).json(path)
    e = doc.select("run_id", "limit", F.posexplode("incidents").alias("pos", "e"))
    return e.select("run_id", "limit", "pos", F.col("e.incident_id").alias("incident_id"),
                    F.col("e.file").alias("file"), F.col("e.root_service").alias("root_service"),
                    parse_iso_strict(F.col("e.window.start")).alias("window_start_us"),
                    parse_iso_strict(F.col("e.window.end")).alias("window_end_us"),
                    F.col("e.traces").alias("traces"), F.col("e.spans").alias("spans"))


def write_evidence_index(entries: DataFrame, path: str, run_id: str, limit: int) -> None:
    """Write the (small, per-run) index as one JSON document, entries in `pos` order."""
    from ..functions.time import iso_utc
    items = entries.select("pos", F.struct(
        "incident_id", "file", "root_service",
        F.struct(iso_utc(F.col("window_start_us"), millis=True).alias("start"),
                 iso_utc(F.col("window_end_us"), millis=True).alias("end")).alias("window"),
        "traces", "spans").alias("e"))
    doc = items.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "e"))), lambda x: x["e"])
                    .alias("incidents")).select(F.lit(run_id).alias("run_id"), F.lit(int(limit)).alias("limit"),
                                                "incidents")
    doc.coalesce(1).write.mode("overwrite").json(path)
