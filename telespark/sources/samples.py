"""Metric samples: matrix documents (O-03) and date-partitioned parquet (O-04)."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MATRIX_SCHEMA = T.StructType([
    T.StructField("status", T.StringType()),
    T.StructField("data", T.StructType([
        T.StructField("resultType", T.StringType()),
        T.StructField("result", T.ArrayType(T.StructType([
            T.StructField("metric", T.MapType(T.StringType(), T.StringType())),
            T.StructField("values", T.ArrayType(T.ArrayType(T.StringType())))])))]))])


def flatten_matrix(docs: DataFrame) -> DataFrame:
    """Matrix documents -> series, labels, ts_us, value.

    One row per (series, sample); pairs whose value does not parse are dropped;
    NaN -> null; series = service_name, else state, else 'all' (blank counts as missing).
    """
    r = docs.select(F.explode("data.result").alias("r"))
    lab = F.col("r.metric")
    name = F.coalesce(F.nullif(lab["service_name"], F.lit("")), F.nullif(lab["state"], F.lit("")), F.lit("all"))
    pairs = r.select(name.alias("series"), lab.alias("labels"), F.explode("r.values").alias("p"))
    ts = F.expr("try_cast(p[0] AS DOUBLE)")
    v = F.expr("try_cast(p[1] AS DOUBLE)")
    out = (pairs.where(F.size("p") >= 2).select("series", "labels", ts.alias("_ts"), v.alias("_v"))
           .where(F.col("_ts").isNotNull() & F.col("_v").isNotNull()))
    return out.select("series", "labels", F.round(F.col("_ts") * 1e6).cast("bigint").alias("ts_us"),
                      F.when(~F.isnan("_v"), F.col("_v")).alias("value"))


def read_samples(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return flatten_matrix(spark.read.schema(MATRIX_SCHEMA).option("multiLine", multi_line).json(path))


def _day(us: int) -> str:
    return datetime.fromtimestamp(us / 1e6, tz=timezone.utc).strftime("%Y-%m-%d")


def write_partitioned(df: DataFrame, path: str, ts: str = "ts_us", mode: str = "append") -> None:
    """Parquet partitioned by UTC date `dt`, so time-bounded reads prune directories."""
    from ..functions.time import utc_wall
    dt = F.date_format(utc_wall(ts), "yyyy-MM-dd")        # UTC date, whatever the session zone
    df.withColumn("dt", dt).write.mode(mode).partitionBy("dt").parquet(path)


def read_table(spark: SparkSession, path: str, start_us: int | None = None, end_us: int | None = None,
               ts: str = "ts_us") -> DataFrame:
    """Read a `dt`-partitioned table for [start, end]: the date predicate prunes
    partitions, the ts predicate is pushed to the parquet reader."""
    df = spark.read.parquet(path)
    if start_us is not None:
        df = df.where(F.col("dt") >= F.lit(_day(start_us))).where(F.col(ts) >= F.lit(start_us))
    if end_us is not None:
        df = df.where(F.col("dt") <= F.lit(_day(end_us))).where(F.col(ts) <= F.lit(end_us))
    return df
