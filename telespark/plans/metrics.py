"""Q-1 query_metrics over a request table (and a gauge table for db_pool).

One plan per call: dense points over the window (each point covers the preceding
rate window), downsampled to the point budget by MAX, summarised per service; for
latency the headline p50/p95/p99 come from one histogram over the whole window
(not a mean of per-step quantiles).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import METRICS, PERCENTILES, POINT_BUDGET, SERVICES
from ..functions.predicates import is_5xx, label_eq, service_selector
from ..operators import counters as C
from ..operators import panes as P
from ..operators import requests as R
from ..operators import series as SR
from ..sources.views import BUCKET_BOUNDS_MS
from .status import points_reason
from .window import US, Window, fetch_step_seconds, rate_window_seconds

GAUGE_LOOKBACK_S = 300


def _le(bounds=BUCKET_BOUNDS_MS):
    le = None
    for b in bounds:
        cond = F.col("duration_ms") <= F.lit(float(b))
        le = F.when(cond, F.lit(float(b))) if le is None else le.when(cond, F.lit(float(b)))
    return le.otherwise(F.lit(float("inf")))


def validate(metric: str, service: str, percentile: int):
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; known: {list(METRICS)}")
    if service not in SERVICES + ("all",):
        raise ValueError(f"unknown service {service!r}; known: {list(SERVICES) + ['all']}")
    if percentile not in PERCENTILES:
        raise ValueError(f"percentile must be one of {list(PERCENTILES)}")
    if metric == "db_pool" and service not in ("inventory", "all"):
        raise ValueError("db_pool exists only for inventory")


def metric_points(requests: DataFrame, metric: str, win: Window, service: str = "all",
                  percentile: int = 95, gauges: DataFrame | None = None) -> DataFrame:
    """Dense points: service, step_us, value."""
    validate(metric, service, percentile)
    rate_us = rate_window_seconds(win.duration_s) * US
    fetch_us = fetch_step_seconds(win.duration_s) * US
    if metric == "db_pool":
        g = label_eq(gauges, pool_name="inventory-pool")
        s = C.gauge_series(g, ["pool_name", "state"], win.start_us, win.end_us, fetch_us, GAUGE_LOOKBACK_S * US)
        return s.groupBy(F.col("state").alias("service"), "step_us").agg(F.sum("value").alias("value"))
    r = service_selector(R.application(requests), service)
    if metric == "error_rate":
        r = r.where(is_5xx("status"))
    rate_s = rate_us / US
    if metric == "latency":
        r, grain, aggs = r.withColumn("le", _le()), ["service", "le"], {"n": F.count(F.lit(1))}
    else:
        grain, aggs = ["service"], {"n": F.count(F.lit(1)), "e": F.count_if(is_5xx("status"))}
    st = P.step_counts(r, grain, aggs, win.start_us, win.end_us, fetch_us, rate_us)
    # dense grid: every step of every series that has samples in range, as the
    # store returns it (rates 0 on quiet steps, undefined quantiles/ratios null)
    # a ratio exists only where its numerator does
    present = (st.where(F.col("e") > 0) if metric == "error_ratio" else st).select("service").distinct()
    grid = SR.step_grid(requests.sparkSession, present, win.start_us, win.end_us, fetch_us)
    if metric == "latency":
        cum = C.cumulative_buckets(st, ["service", "step_us"], bounds=BUCKET_BOUNDS_MS)
        q = C.histogram_quantile(cum, ["service", "step_us"], {"value": percentile / 100.0})
        return grid.join(q, ["service", "step_us"], "left")
    g = grid.join(st, ["service", "step_us"], "left").fillna(0, ["n", "e"])
    value = {"request_rate": F.col("n") / rate_s, "error_rate": F.col("n") / rate_s,
             "error_ratio": F.when(F.col("n") > 0, 100.0 * F.col("e") / F.col("n"))}[metric]
    return g.select("service", "step_us", value.alias("value"))


def headline_percentiles(requests: DataFrame, win: Window, service: str = "all") -> DataFrame:
    """p50/p95/p99 per service from one histogram over (start, end]."""
    r = service_selector(R.application(requests), service)
    r = r.where((F.col("ts_us") > win.start_us) & (F.col("ts_us") <= win.end_us))
    b = r.groupBy("service", _le().alias("le")).agg(F.count(F.lit(1)).alias("n"))
    cum = C.cumulative_buckets(b, ["service"], bounds=BUCKET_BOUNDS_MS)
    return C.histogram_quantile(cum, ["service"], {f"p{p}": p / 100.0 for p in PERCENTILES})


def query_metrics(requests: DataFrame, metric: str, win: Window, as_of_us: int,
                  service: str = "all", percentile: int = 95, gauges: DataFrame | None = None,
                  retention_hours: float = 24.0, budget: int = POINT_BUDGET) -> dict:
    """Returns {'series', 'points', 'status'} DataFrames.

    series: service, [p50, p95, p99,] min, max, avg, points, peak_at_us
    points: service, bucket, bucket_start_us, value (<= budget per service)
    status: status ('ok'|'empty', by the points), reason, value (0 for an empty error metric)
    """
    pts = metric_points(requests, metric, win, service, percentile, gauges)
    series = SR.summarize(pts, ["service"])
    if metric == "latency":
        series = series.join(headline_percentiles(requests, win, service), "service", "left")
    points = SR.downsample_max(pts, ["service"], budget=budget)
    src = gauges if metric == "db_pool" else requests
    status = points_reason(pts, src, metric, service, as_of_us, retention_hours)
    return {"series": series, "points": points, "status": status}
