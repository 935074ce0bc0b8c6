"""Incident labels as JSON Lines (O-01, O-05, O-11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.time import parse_iso_strict

_RECOVERY = T.StructType([
    T.StructField("recovered", T.BooleanType()), T.StructField("recovery_s", T.DoubleType()),
    T.StructField("inert", T.BooleanType()), T.StructField("probe_failures", T.IntegerType()),
    T.StructField("probe_p95_ms", T.DoubleType()), T.StructField("probe_ceiling_ms", T.DoubleType())])

LABEL_SCHEMA = T.StructType([
    T.StructField("schema", T.IntegerType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("incident_id", T.StringType()),
    T.StructField("start", T.StringType()),
    T.StructField("end", T.StringType()),
    T.StructField("confirmed_start", T.StringType()),
    T.StructField("confirmed_end", T.StringType()),
    T.StructField("service", T.StringType()),
    T.StructField("fault_type", T.StringType()),
    T.StructField("params", T.StructType([T.StructField(k, T.IntegerType()) for k in ("ms", "jitter", "pct", "hold")])),
    T.StructField("expected_signal", T.ArrayType(T.StringType())),
    T.StructField("observed", T.StructType([T.StructField(k, T.LongType()) for k in
                                            ("requests_seen", "requests_delayed", "requests_failed")])),
    T.StructField("recovered", T.BooleanType()),
    T.StructField("recovery_s", T.DoubleType()),
    T.StructField("recovery_detail", _RECOVERY),
    T.StructField("jaeger_url", T.StringType()),
])


def read_incidents(spark: SparkSession, path: str, run: str | None = None,
                   mode: str = "PERMISSIVE") -> DataFrame:
    """Labels with an explicit schema; blank lines are skipped by the reader,
    malformed lines land in `_corrupt_record` (PERMISSIVE) or fail (FAILFAST).
    Adds epoch-µs bounds (null when a timestamp has no zone) and observed counts."""
    schema = (T.StructType(LABEL_SCHEMA.fields + [T.StructField("_corrupt_record", T.StringType())])
              if mode == "PERMISSIVE" else LABEL_SCHEMA)
    df = (spark.read.schema(schema).option("mode", mode)
          .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    if run is not None:
        df = df.where(F.col("run_id") == run)
    return (df.withColumn("start_us", parse_iso_strict("start"))
            .withColumn("end_us", parse_iso_strict("end"))
            .withColumn("confirmed_start_us", parse_iso_strict("confirmed_start"))
            .withColumn("confirmed_end_us", parse_iso_strict("confirmed_end"))
            .withColumn("requests_seen", F.col("observed.requests_seen"))
            .withColumn("requests_failed", F.col("observed.requests_failed")))


def failure_share(labels: DataFrame) -> DataFrame:
    """O-54: labelled failed % = 100*failed/seen (null when nothing was seen)."""
    return labels.withColumn("failed_pct", 100.0 * F.col("observed.requests_failed")
                             / F.nullif(F.col("observed.requests_seen"), F.lit(0)))


def write_incidents(df: DataFrame, path: str) -> None:
    """Append labels as JSON Lines; internal `_` columns and derived µs columns are
    not part of the label format and are dropped."""
    keep = [c for c in df.columns if not c.startswith("_") and c in LABEL_SCHEMA.fieldNames()]
    df.select(*keep).write.mode("append").json(path)


def run_meta(spark: SparkSession, run_id: str, started_us: int, ended_us: int,
             baseline_start_us: int, baseline_end_us: int, incidents: DataFrame,
             signals: DataFrame) -> DataFrame:
    """One-row run document: bounds, baseline window, incident ids, signal rows.
    Both inputs are per-run reports (a handful of rows)."""
    from ..functions.time import iso_utc
    inc = incidents.agg(F.array_sort(F.collect_list("incident_id")).alias("incidents"))
    sig = signals.agg(F.collect_list(F.struct(*signals.columns)).alias("signals"))
    from ..operators.joins import join_single_rows
    head = spark.range(1).select(
        F.lit(run_id).alias("run_id"), iso_utc(F.lit(started_us)).alias("started"),
        iso_utc(F.lit(ended_us)).alias("ended"),
        F.struct(iso_utc(F.lit(baseline_start_us)).alias("start"),
                 iso_utc(F.lit(baseline_end_us)).alias("end")).alias("baseline_window"))
    return join_single_rows(head, inc, sig)
