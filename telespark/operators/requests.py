"""RED metrics from request rows (request_id, ts_us, service, route, status, duration_ms).

Rates divide by the range in seconds; ratios are null when the denominator is 0.
All are plain grouped aggregates (partial aggregation before the shuffle), so a hot
service costs one pre-aggregated row per task, not a hot partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import app_routes, is_5xx, is_ok
from .panes import step_counts
from .quantiles import exact_percentiles


def application(requests: DataFrame) -> DataFrame:
    return requests.where(app_routes("route"))


def red_aggs() -> dict:
    """The RED counts by name; they add up over panes and windows."""
    return {"requests": F.count(F.lit(1)), "errors_5xx": F.count_if(is_5xx("status"))}


def red_counts(df: DataFrame, keys) -> DataFrame:
    return df.groupBy(*keys).agg(*[a.alias(n) for n, a in red_aggs().items()])


def with_rates(counts: DataFrame, range_s: float) -> DataFrame:
    """request_rate, error_rate (per second) and error_ratio (%) from counts."""
    return (counts.withColumn("request_rate", F.col("requests") / F.lit(float(range_s)))
            .withColumn("error_rate", F.col("errors_5xx") / F.lit(float(range_s)))
            .withColumn("error_ratio", F.when(F.col("requests") > 0,
                                              100.0 * F.col("errors_5xx") / F.col("requests"))))


def red_series(requests: DataFrame, start_us: int, end_us: int, step_us: int, range_us: int,
               service_col: str = "service") -> DataFrame:
    """Per (service, step): requests, errors_5xx and the three rates over (t-range, t],
    application routes only; numerator and denominator share the exclusion."""
    counts = step_counts(application(requests), [service_col], red_aggs(), start_us, end_us, step_us, range_us)
    return with_rates(counts, range_us / 1e6)


def window_totals(requests: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """Per service over [start, end] (inclusive), application routes only."""
    r = application(requests).where(F.col("ts_us").between(start_us, end_us))
    return with_rates(red_counts(r, ["service"]), (end_us - start_us) / 1e6)


def latency_percentiles(requests: DataFrame, keys=("service",), method: str = "linear",
                        fractions=None, count_col: str | None = None) -> DataFrame:
    """Exact window-wide p50/p95/p99 of duration_ms per key (one pass, not a mean of
    per-step quantiles). method 'linear' (numpy) or 'nearest' (sorted[min(n-1, int(n*f))])."""
    fractions = fractions or {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    return exact_percentiles(requests, list(keys), "duration_ms", fractions, method, count_col)


def status_histogram(requests: DataFrame, interval_us: int, start_us: int = 0) -> DataFrame:
    """Per interval and status: count; plus sent / ok / failed and achieved rate per
    interval (O-53). status may be an int code or an exception name."""
    iv = (F.lit(start_us) + F.floor((F.col("ts_us") - F.lit(start_us)) / F.lit(interval_us))
          .cast("bigint") * F.lit(interval_us))
    s = requests.withColumn("interval_us", iv).withColumn("status_key", F.col("status").cast("string"))
    by_status = s.groupBy("interval_us", "status_key").agg(F.count(F.lit(1)).alias("n"))
    totals = s.groupBy("interval_us").agg(
        F.count(F.lit(1)).alias("sent"),
        F.count_if(is_ok(F.col("status_key"))).alias("ok"))
    totals = (totals.withColumn("failed", F.col("sent") - F.col("ok"))
              .withColumn("rate_per_s", F.col("sent") / F.lit(interval_us / 1e6)))
    return by_status.join(totals, "interval_us")
