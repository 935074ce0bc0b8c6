"""Time-series shaping: step assignment, sliding windows, zero fill, downsampling,
summaries and peaks.

Evaluation steps are t_k = start + k*step, k = 0..K. A value at t_k covers the
right-closed range (t_k - w, t_k] (PromQL range semantics).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import POINT_BUDGET


def n_steps(start_us: int, end_us: int, step_us: int) -> int:
    return int((end_us - start_us) // step_us)


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def assign_steps(df: DataFrame, start_us, end_us, step_us, range_us, ts: str = "ts_us") -> DataFrame:
    """Adds `step_us` (the evaluation instant) for every step whose range holds the row.

    A row at ts belongs to steps k with t_k - range < ts <= t_k, i.e.
    k in [ceil((ts-start)/step), ceil((ts-start+range)/step) - 1], clipped to
    [0, K], K = (end-start) div step. Fan-out is range/step per row (bounded by
    the caller's sizing), and the following aggregation is an equi-grouping
    instead of a range join. The bounds may be ints or per-row Columns (e.g. one
    window per incident after a join).
    """
    start, end, step, rng = _lit(start_us), _lit(end_us), _lit(step_us), _lit(range_us)
    k_max = F.floor((end - start) / step).cast("bigint")
    rel = F.col(ts) - start
    lo = F.greatest(F.lit(0).cast("bigint"), F.ceil(rel / step).cast("bigint"))
    hi = F.least(k_max, F.ceil((rel + rng) / step).cast("bigint") - 1)
    pre = df.where((F.col(ts) > start - rng) & (F.col(ts) <= end))
    # sequence(lo, hi) counts down when lo > hi, so guard it: no step holds the row
    ks = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))
    out = pre.withColumn("_k", F.explode(ks))
    return out.withColumn("step_us", start + F.col("_k") * step).drop("_k")


def tumbling_step(ts: str, start_us: int, step_us: int) -> Column:
    """The single right-closed step (t - step, t] holding ts (range == step)."""
    rel = F.col(ts) - F.lit(start_us)
    return F.lit(start_us) + F.ceil(rel / F.lit(step_us)).cast("bigint") * F.lit(step_us)


def step_grid(spark, keys_df: DataFrame, start_us: int, end_us: int, step_us: int) -> DataFrame:
    """keys x evaluation steps (expected series only, so no phantom label set)."""
    k_max = n_steps(start_us, end_us, step_us)
    return keys_df.select("*", F.explode(F.sequence(F.lit(0), F.lit(k_max))).alias("_k")) \
        .withColumn("step_us", F.lit(start_us) + F.col("_k").cast("bigint") * F.lit(step_us)).drop("_k")


def zero_fill(values: DataFrame, grid: DataFrame, keys, value_cols) -> DataFrame:
    """`or vector(0)` done safely: grid left join values, missing -> 0."""
    j = grid.join(values, list(keys), "left")
    for c in value_cols:
        j = j.withColumn(c, F.coalesce(F.col(c), F.lit(0)))
    return j


def downsample_max(points: DataFrame, keys, ts: str = "step_us", value: str = "value",
                   budget: int = POINT_BUDGET) -> DataFrame:
    """At most `budget` points per series: MAX per proportional index bucket.

    Point j of n (0-based, by ts) goes to bucket (budget*(j+1) - 1) div n, i.e. the
    buckets [floor(b*n/budget), floor((b+1)*n/budget)). Nulls are ignored; an
    all-null bucket yields null; a series of <= budget points is returned as is
    (bucket = j). The window runs over one series' points, which the step sizing
    bounds (~600), never over raw rows.
    Output: keys..., bucket, bucket_start_us, value.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(ts)
    p = (points.withColumn("_j", F.row_number().over(w) - 1)
         .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))))
    b = F.when(F.col("_n") <= budget, F.col("_j")).otherwise(
        F.floor((F.lit(budget) * (F.col("_j") + 1) - 1) / F.col("_n")))
    return (p.withColumn("bucket", b.cast("int"))
            .groupBy(*keys, "bucket")
            .agg(F.min(ts).alias("bucket_start_us"), F.max(value).alias(value)))


def summarize(points: DataFrame, keys, ts: str = "step_us", value: str = "value") -> DataFrame:
    """min / max / avg over non-null points and the instant of the max (first on ties)."""
    nn = points.where(F.col(value).isNotNull() & ~F.isnan(value))
    return nn.groupBy(*keys).agg(
        F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("avg"),
        F.count(F.lit(1)).alias("points"),
        F.min_by(F.col(ts), F.struct(-F.col(value), F.col(ts))).alias("peak_at_us"))


def last_non_null(points: DataFrame, keys, ts: str = "step_us", value: str = "value") -> DataFrame:
    """Panel summaries: last non-null value, mean and max per series (O-45)."""
    nn = points.where(F.col(value).isNotNull() & ~F.isnan(value))
    return nn.groupBy(*keys).agg(F.max_by(value, ts).alias("last"), F.avg(value).alias("mean"),
                                 F.max(value).alias("max"))


def ratio_series(numerator: DataFrame, denominator: DataFrame, keys, scale: float = 100.0) -> DataFrame:
    """`scale * num / den` matched one-to-one on `keys` (e.g. service, step_us):
    an inner join, so a step without a numerator series yields no row; a zero
    denominator yields null."""
    n = numerator.select(*keys, F.col("value").alias("_num"))
    d = denominator.select(*keys, F.col("value").alias("_den"))
    return n.join(d, list(keys)).select(
        *keys, F.when(F.col("_den") != 0, F.lit(scale) * F.col("_num") / F.col("_den")).alias("value"))
