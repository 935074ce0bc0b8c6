"""Counters, histograms and gauges stored as samples (series labels..., ts_us, value).

Counter deltas need each sample's predecessor. A `lag` over a whole series would put
a long-lived series in one task, so the lag runs inside (series, day) partitions and
the first sample of a day takes its predecessor from the last sample of the nearest
earlier day (a per-(series, day) aggregate: tiny).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import nan_to_null
from .panes import step_counts
from .series import assign_steps

DAY_US = 86400 * 1000000


def counter_deltas(samples: DataFrame, keys, part_us: int = DAY_US) -> DataFrame:
    """Adds prev_ts_us, prev_value and delta for each sample.

    delta = value - prev when the counter did not fall, value when it fell (reset),
    0 for the first sample of a series (its birth carries no known increase).
    NaN values are treated as missing samples.
    """
    keys = list(keys)
    s = (samples.withColumn("value", nan_to_null("value")).where(F.col("value").isNotNull())
         .withColumn("_day", F.floor(F.col("ts_us") / F.lit(part_us)).cast("bigint")))
    day_last = s.groupBy(*keys, "_day").agg(F.max_by(F.struct("ts_us", "value"), "ts_us").alias("_last"))
    carry = (day_last.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_day")))
             .select(*keys, "_day", "_carry"))
    w = Window.partitionBy(*keys, "_day").orderBy("ts_us")
    s = (s.withColumn("_p_ts", F.lag("ts_us").over(w)).withColumn("_p_v", F.lag("value").over(w))
         .join(carry, keys + ["_day"], "left"))
    prev_ts = F.coalesce(F.col("_p_ts"), F.col("_carry.ts_us"))
    prev_v = F.coalesce(F.col("_p_v"), F.col("_carry.value"))
    delta = (F.when(prev_v.isNull(), F.lit(0.0))
             .when(F.col("value") >= prev_v, F.col("value") - prev_v)
             .otherwise(F.col("value")))
    return (s.withColumn("prev_ts_us", prev_ts).withColumn("prev_value", prev_v)
            .withColumn("delta", delta).drop("_day", "_p_ts", "_p_v", "_carry"))


def increase_exact(deltas: DataFrame, keys, start_us: int, end_us: int) -> DataFrame:
    """Reset-aware increase over [start, end] per group: sum of deltas of samples in it."""
    return (deltas.where(F.col("ts_us").between(start_us, end_us))
            .groupBy(*keys).agg(F.sum("delta").alias("increase")))


def rate_series(deltas: DataFrame, keys, start_us: int, end_us: int, step_us: int,
                range_us: int, mode: str = "exact") -> DataFrame:
    """Per series and step: rate over (t-range, t].

    exact   sum of deltas of the samples in range / range seconds
    promql  Prometheus extrapolated rate: increase between the first and last sample
            in range (resets corrected), extrapolated towards the range edges (by at
            most half a sample interval, and not below zero for counters); needs two
            samples.
    """
    keys = list(keys)
    range_s = range_us / 1e6
    if mode == "exact":
        return (step_counts(deltas, keys, {"increase": F.sum("delta")}, start_us, end_us, step_us, range_us)
                .withColumn("rate", F.col("increase") / F.lit(range_s)))
    if mode != "promql":
        raise ValueError("mode must be 'exact' or 'promql'")
    st = assign_steps(deltas, start_us, end_us, step_us, range_us)
    in_range_prev = F.col("prev_ts_us") > (F.col("step_us") - F.lit(range_us))
    g = st.groupBy(*keys, "step_us").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("ts_us").alias("_t0"), F.max("ts_us").alias("_t1"),
        F.min_by("value", "ts_us").alias("_v0"),
        F.sum(F.when(in_range_prev, F.col("delta")).otherwise(F.lit(0.0))).alias("_inc"))
    # two samples at distinct instants are needed (a zero sampled interval would
    # divide by zero, which ANSI mode raises)
    g = g.where((F.col("_n") >= 2) & (F.col("_t1") > F.col("_t0")))
    sampled = (F.col("_t1") - F.col("_t0")) / 1e6
    avg_gap = sampled / (F.col("_n") - 1)
    to_start = (F.col("_t0") - (F.col("step_us") - F.lit(range_us))) / 1e6
    to_end = (F.col("step_us") - F.col("_t1")) / 1e6
    to_zero = F.when((F.col("_inc") > 0) & (F.col("_v0") >= 0), sampled * (F.col("_v0") / F.col("_inc")))
    to_start = F.when(to_zero.isNotNull() & (to_zero < to_start), to_zero).otherwise(to_start)
    thr = avg_gap * 1.1
    ext = (sampled + F.when(to_start < thr, to_start).otherwise(avg_gap / 2)
           + F.when(to_end < thr, to_end).otherwise(avg_gap / 2))
    inc = F.col("_inc") * (ext / sampled)
    return g.select(*keys, "step_us", inc.alias("increase"), (inc / F.lit(range_s)).alias("rate"))


def cumulative_buckets(bucket_obs: DataFrame, keys, le: str = "le", n: str = "n",
                       bounds=None) -> DataFrame:
    """Per-bucket observations -> cumulative counts per le (running sum over <= #bounds
    rows per group).

    With `bounds`, every group gets every bound (and +Inf), empty ones with 0, as a
    histogram store has them: the lower edge of the first populated bucket is then
    the previous bound, not 0. The fan-out is #bounds per group, never per row.
    """
    keys = list(keys)
    if bounds is not None:
        grid = bucket_obs.select(*keys).distinct().select(
            *keys, F.explode(F.array(*[F.lit(float(b)) for b in bounds], F.lit(float("inf")))).alias(le))
        bucket_obs = (grid.join(bucket_obs.select(*keys, le, n), keys + [le], "left")
                      .withColumn(n, F.coalesce(F.col(n), F.lit(0))))
    w = Window.partitionBy(*keys).orderBy(le).rowsBetween(Window.unboundedPreceding, 0)
    return bucket_obs.withColumn("cum", F.sum(n).over(w))


def histogram_quantile(cum: DataFrame, keys, qs, le: str = "le", cum_col: str = "cum") -> DataFrame:
    """Prometheus histogram_quantile over cumulative `le` buckets (the +Inf bucket
    holds the total), for several quantiles in one pass.

    `qs` is a float or a dict name -> q. rank = q * total; the first bucket with
    cum >= rank holds it; linear interpolation inside it from the previous bound
    (0 for the first bucket); in the +Inf bucket the answer is the highest finite
    bound; total 0 -> no value. Windows here run over <= #bounds rows per group.
    """
    keys = list(keys)
    if not isinstance(qs, dict):
        qs = {"quantile": float(qs)}
    w = Window.partitionBy(*keys).orderBy(le)
    c = (cum.withColumn("_prev_cum", F.coalesce(F.lag(cum_col).over(w), F.lit(0)))
         .withColumn("_prev_le", F.lag(le).over(w))
         .withColumn("_total", F.max(cum_col).over(Window.partitionBy(*keys))))
    qarr = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(q)).alias("q")) for n, q in qs.items()])
    c = c.select("*", F.explode(qarr).alias("_q")).withColumn("_rank", F.col("_q.q") * F.col("_total"))
    hit = c.where((F.col("_total") > 0) & (F.col(cum_col) >= F.col("_rank")))
    first = hit.groupBy(*keys, F.col("_q.name").alias("_name")).agg(
        F.min_by(F.struct(le, "_prev_le", "_prev_cum", cum_col, "_rank"), le).alias("_h"))
    h = lambda f: F.col("_h")[f]
    start = F.when(h("_prev_le").isNull(), F.lit(0.0)).otherwise(h("_prev_le"))
    inside = start + (h(le) - start) * ((h("_rank") - h("_prev_cum")) / (h(cum_col) - h("_prev_cum")))
    val = (F.when(h(le) == float("inf"), h("_prev_le"))
           .when(h("_prev_le").isNull() & (h(le) <= 0), h(le))
           .when(h(cum_col) == h("_prev_cum"), h(le))
           .otherwise(inside))
    per = first.select(*keys, "_name", val.alias("_val"))
    return per.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == n, F.col("_val"))).alias(n) for n in qs])


def gauge_at(samples: DataFrame, keys, at_us: int, lookback_us: int = 300 * 1000000) -> DataFrame:
    """Instant value of each gauge series at `at_us`: its latest sample within the
    lookback (the store's staleness rule); series without one are absent."""
    nn = samples.withColumn("value", nan_to_null("value")).where(F.col("value").isNotNull())
    r = nn.where((F.col("ts_us") > at_us - lookback_us) & (F.col("ts_us") <= at_us))
    return r.groupBy(*keys).agg(F.max_by("value", "ts_us").alias("value"))


def gauge_series(samples: DataFrame, keys, start_us: int, end_us: int, step_us: int,
                 lookback_us: int = 300 * 1000000) -> DataFrame:
    """Per series and step: latest sample in (t - lookback, t]."""
    nn = samples.withColumn("value", nan_to_null("value")).where(F.col("value").isNotNull())
    st = assign_steps(nn, start_us, end_us, step_us, lookback_us)
    return st.groupBy(*keys, "step_us").agg(F.max_by("value", "ts_us").alias("value"))
