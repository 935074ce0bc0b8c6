"""Registered request-metric queries (O-12, O-15, O-16, O-21, O-33..O-42, O-53, O-63)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import register, r6
from .operators import requests as R
from .operators import series as SR
from .operators.joins import interval_join
from .operators.quantiles import exact_percentiles
from .plans.oracle_views import APP, nearest_sql, with_views
from .sources import views as V

FIX_START = V.EPOCH_2024_US
FIX_END = V.EPOCH_2024_US + 30 * V.DAY_US
DAY = V.DAY_US
HOUR = V.HOUR_US

_DAILY = f"""daily AS (
  SELECT service, {FIX_START} + CAST(ceil((ts_us - {FIX_START}) / {DAY}) AS BIGINT) * {DAY} AS step_us,
    count(*) AS requests, count(*) FILTER (WHERE status BETWEEN 500 AND 599) AS errors_5xx
  FROM requests WHERE {APP} AND ts_us > {FIX_START - DAY} AND ts_us <= {FIX_END} GROUP BY 1, 2)"""


def _daily(spark, sf_dir):
    return R.red_series(V.requests(spark, sf_dir), FIX_START, FIX_END, DAY, DAY)


@register("request_rate", with_views("requests") + ", " + _DAILY + """
SELECT service, step_us, requests, requests / 86400.0 AS request_rate FROM daily""")
def q_request_rate(spark, sf_dir):
    return _daily(spark, sf_dir).select("service", "step_us", "requests", "request_rate")


@register("error_rate", with_views("requests") + ", " + _DAILY + """
SELECT service, step_us, errors_5xx, errors_5xx / 86400.0 AS error_rate FROM daily""")
def q_error_rate(spark, sf_dir):
    return _daily(spark, sf_dir).select("service", "step_us", "errors_5xx", "error_rate")


@register("error_ratio", with_views("requests") + ", " + _DAILY + """
SELECT service, step_us, round(100.0 * errors_5xx / nullif(requests, 0), 6) AS error_ratio FROM daily""")
def q_error_ratio(spark, sf_dir):
    return _daily(spark, sf_dir).select("service", "step_us", r6("error_ratio").alias("error_ratio"))


@register("latency_percentiles", with_views("requests") + f"""
SELECT service, count(*) AS requests,
  round(quantile_cont(duration_ms, 0.5), 6) AS p50, round(quantile_cont(duration_ms, 0.95), 6) AS p95,
  round(quantile_cont(duration_ms, 0.99), 6) AS p99
FROM requests WHERE {APP} GROUP BY service""")
def q_latency_percentiles(spark, sf_dir):
    app = R.application(V.requests(spark, sf_dir))
    p = R.latency_percentiles(app, count_col="requests")
    return p.select("service", "requests", r6("p50").alias("p50"), r6("p95").alias("p95"), r6("p99").alias("p99"))


@register("nearest_percentiles", with_views("requests") + ", app AS (SELECT * FROM requests WHERE "
          + APP + ")\n" + nearest_sql("app", "service", "duration_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99}))
def q_nearest_percentiles(spark, sf_dir):
    app = R.application(V.requests(spark, sf_dir))
    return R.latency_percentiles(app, method="nearest")


@register("phase_p95", with_views("requests_faulted", "incidents") + f""",
phased AS (
  SELECT i.incident_id AS phase, r.service, r.duration_ms
  FROM requests_faulted r JOIN incidents i ON r.ts_us BETWEEN i.start_us AND i.end_us WHERE {APP}
  UNION ALL
  SELECT 'baseline', service, duration_ms FROM requests_faulted
  WHERE {APP} AND ts_us BETWEEN {V.BASELINE_START_US} AND {V.BASELINE_END_US})
SELECT phase, service, count(*) AS requests, round(quantile_cont(duration_ms, 0.95), 6) AS p95
FROM phased GROUP BY 1, 2""")
def q_phase_p95(spark, sf_dir):
    """Golden table of FIXTURES 2.3: exact p95 per phase (baseline / incident) and service."""
    app = R.application(V.requests_faulted(spark, sf_dir))
    inc = V.incidents(spark).select("incident_id", F.col("start_us").alias("i_start"),
                                    F.col("end_us").alias("i_end"))
    in_inc = interval_join(app, inc, "ts_us", "i_start", "i_end", DAY).withColumnRenamed("incident_id", "phase")
    base = app.where(F.col("ts_us").between(V.BASELINE_START_US, V.BASELINE_END_US)) \
        .withColumn("phase", F.lit("baseline"))
    rows = in_inc.select("phase", "service", "duration_ms").unionByName(base.select("phase", "service", "duration_ms"))
    p = exact_percentiles(rows, ["phase", "service"], "duration_ms", {"p95": 0.95}, count_col="requests")
    return p.select("phase", "service", "requests", r6("p95").alias("p95"))


@register("series_summary", with_views("requests") + f""",
pts AS (
  SELECT service, {FIX_START} + CAST(ceil((ts_us - {FIX_START}) / {DAY}) AS BIGINT) * {DAY} AS step_us,
    quantile_cont(duration_ms, 0.95) AS value
  FROM requests WHERE {APP} AND ts_us > {FIX_START - DAY} AND ts_us <= {FIX_END} GROUP BY 1, 2)
SELECT service, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS avg,
  count(*) AS points, arg_min(step_us, (-value, step_us)) AS peak_at_us
FROM pts GROUP BY service""")
def q_series_summary(spark, sf_dir):
    app = R.application(V.requests(spark, sf_dir))
    st = SR.assign_steps(app, FIX_START, FIX_END, DAY, DAY)
    pts = exact_percentiles(st, ["service", "step_us"], "duration_ms", {"value": 0.95})
    s = SR.summarize(pts, ["service"])
    return s.select("service", r6("min").alias("min"), r6("max").alias("max"), r6("avg").alias("avg"),
                    "points", "peak_at_us")


@register("status_histogram", with_views("requests") + f"""
SELECT b.interval_us, b.status_key, b.n, t.sent, t.ok, t.sent - t.ok AS failed, t.sent / 86400.0 AS rate_per_s
FROM (SELECT {FIX_START} + CAST(floor((ts_us - {FIX_START}) / {DAY}) AS BIGINT) * {DAY} AS interval_us,
        CAST(status AS VARCHAR) AS status_key, count(*) AS n FROM requests GROUP BY 1, 2) b
JOIN (SELECT {FIX_START} + CAST(floor((ts_us - {FIX_START}) / {DAY}) AS BIGINT) * {DAY} AS interval_us,
        count(*) AS sent, count(*) FILTER (WHERE status >= 200 AND status < 400) AS ok FROM requests GROUP BY 1) t
ON b.interval_us = t.interval_us""")
def q_status_histogram(spark, sf_dir):
    return R.status_histogram(V.requests(spark, sf_dir), DAY, FIX_START).select(
        "interval_us", "status_key", "n", "sent", "ok", "failed", "rate_per_s")


# trailing statistics over the last 2000 requests, evaluated at each day end
_TRAIL_N = 2000


@register("trailing_percentiles", with_views("requests") + f""",
instants AS (SELECT {FIX_START} + r.range * {DAY} AS at_us FROM range(1, 31) r),
last_n AS (
  SELECT at_us, duration_ms FROM (
    SELECT i.at_us, q.duration_ms, row_number() OVER (PARTITION BY i.at_us ORDER BY q.ts_us DESC, q.request_id DESC) AS k
    FROM instants i JOIN requests q ON q.ts_us <= i.at_us) x WHERE k <= {_TRAIL_N})
""" + nearest_sql("last_n", "at_us", "duration_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99}))
def q_trailing_percentiles(spark, sf_dir):
    from .plans.load import trailing_percentiles
    instants = [FIX_START + k * DAY for k in range(1, 31)]
    return trailing_percentiles(V.requests(spark, sf_dir), instants, _TRAIL_N).select(
        "at_us", "p50", "p95", "p99")
