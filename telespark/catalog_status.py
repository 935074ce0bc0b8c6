"""Registered coverage / empty-result / set-operation queries and the metric query
(O-29, O-30, O-50..O-52, O-72, O-73, Q-1, Q-4, Q-10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import register, r6
from .config import SERVICES
from .functions.predicates import app_routes, is_5xx
from .operators import requests as R
from .operators import series as SR
from .plans import metrics as M
from .plans import status as ST
from .plans.oracle_views import APP, hq_ctes, le_case, with_views
from .plans.window import Window
from .sources import views as V

S0 = V.EPOCH_2024_US
E0 = V.EPOCH_2024_US + 30 * V.DAY_US
DAY = V.DAY_US
HOUR = V.HOUR_US
_SVC_VALUES = ", ".join(f"('{s}')" for s in SERVICES)


def _expected(spark):
    return spark.createDataFrame([(s,) for s in SERVICES], "service string")


@register("reporting_services", with_views("requests") + f""",
steps AS (SELECT {S0} + r.range * {HOUR} AS t FROM range(0, {(E0 - S0) // HOUR + 1}) r)
SELECT DISTINCT s.t AS step_us, q.service FROM steps s JOIN requests q
  ON q.ts_us > s.t - 300000000 AND q.ts_us <= s.t WHERE q.service IS NOT NULL AND trim(q.service) <> ''""")
def q_reporting_services(spark, sf_dir):
    """Services with data in the 5 minutes before every hour end."""
    return ST.reporting_services(V.requests(spark, sf_dir), S0, E0, HOUR)


@register("silent_services", with_views("requests") + f""",
steps AS (SELECT {S0} + r.range * {HOUR} AS t FROM range(0, {(E0 - S0) // HOUR + 1}) r),
rep AS (SELECT DISTINCT s.t, q.service FROM steps s JOIN requests q ON q.ts_us > s.t - 300000000 AND q.ts_us <= s.t),
grid AS (SELECT s.t, e.service FROM steps s, (VALUES {_SVC_VALUES}) e(service))
SELECT g.t AS step_us, g.service FROM grid g WHERE NOT EXISTS
  (SELECT 1 FROM rep r WHERE r.t = g.t AND r.service = g.service)""")
def q_silent_services(spark, sf_dir):
    """Expected services without any data in the 5 minutes before each hour end."""
    rep = ST.reporting_services(V.requests(spark, sf_dir), S0, E0, HOUR)
    return ST.silent_services(rep, spark, S0, E0, HOUR).select("step_us", "service")


@register("telemetry_status", with_views("requests") + f""",
rep AS (SELECT DISTINCT service FROM requests WHERE ts_us > {E0} - 3600000000 AND ts_us <= {E0}),
mis AS (SELECT service FROM (VALUES {_SVC_VALUES}) e(service) WHERE service NOT IN (SELECT service FROM rep)),
old AS (SELECT min(ts_us) AS m FROM requests WHERE ts_us BETWEEN {E0 - 10 * DAY} AND {E0})
SELECT coalesce((SELECT string_agg(service, ',' ORDER BY service) FROM rep), '') AS reporting,
  coalesce((SELECT string_agg(service, ',' ORDER BY service) FROM mis), '') AS not_reporting,
  {E0 - 10 * DAY} + CAST(ceil((m - {E0 - 10 * DAY}) / 300000000) AS BIGINT) * 300000000 AS oldest_us,
  CASE WHEN m IS NULL THEN 'degraded' ELSE 'ok' END AS status
FROM old""")
def q_telemetry_status(spark, sf_dir):
    """Coverage at the end of the data: who reported in the last hour, who did not,
    oldest queryable instant within a 10-day retention on the 300 s grid."""
    return ST.telemetry_status(V.requests(spark, sf_dir), spark, E0, 240, lookback_s=3600).select(
        "reporting", "not_reporting", "oldest_us", "status")


# spans lie in 1995..2001; moved by whole days so that a part of them is in the retention
TRACE_SHIFT = 8400 * DAY


def _svc_list(table: str, ts: str, back: int, shift: int = 0) -> str:
    return (f"SELECT DISTINCT service FROM {table} WHERE {ts} + {shift} > {E0 - back} AND {ts} + {shift} <= {E0} "
            "AND service IS NOT NULL AND trim(service) <> ''")


@register("telemetry_status_stores", with_views("requests", "spans") + f""",
rep AS ({_svc_list("requests", "ts_us", DAY)}),
trep AS ({_svc_list("spans", "start_us", DAY, TRACE_SHIFT)}),
e AS (SELECT service FROM (VALUES {_SVC_VALUES}) e(service)),
old AS (SELECT min(ts_us) AS m FROM requests WHERE ts_us BETWEEN {E0 - 10 * DAY} AND {E0}),
told AS (SELECT min(start_us + {TRACE_SHIFT}) AS t FROM spans WHERE start_us + {TRACE_SHIFT} BETWEEN {E0 - 2 * DAY} AND {E0}),
one AS (SELECT coalesce((SELECT string_agg(service, ',' ORDER BY service) FROM rep), '') AS reporting,
  coalesce((SELECT string_agg(service, ',' ORDER BY service) FROM e WHERE service NOT IN (SELECT service FROM rep)), '') AS not_reporting,
  {E0 - 10 * DAY} + CAST(ceil((m - {E0 - 10 * DAY}) / 300000000) AS BIGINT) * 300000000 AS oldest_us,
  CASE WHEN m IS NULL THEN 'degraded' ELSE 'ok' END AS metrics_status,
  CASE WHEN t IS NULL THEN 'degraded' ELSE 'ok' END AS traces_status, t AS traces_oldest_us,
  CAST(48 AS DOUBLE) AS traces_retention_hours, 'always_on' AS traces_sampling,
  coalesce((SELECT string_agg(service, ',' ORDER BY service) FROM trep), '') AS traces_reporting,
  coalesce((SELECT string_agg(service, ',' ORDER BY service) FROM e WHERE service NOT IN (SELECT service FROM trep)), '') AS traces_not_reporting
FROM old, told)
SELECT *, CASE WHEN metrics_status = 'ok' AND traces_status = 'ok' THEN 'ok' ELSE 'degraded' END AS status,
  CASE WHEN metrics_status <> 'ok' OR traces_status <> 'ok' THEN '{ST.STORE_NOTE}' END AS note FROM one""")
def q_telemetry_status_stores(spark, sf_dir):
    """Coverage of both stores, each with its own retention."""
    spans = V.spans_table(spark, sf_dir).withColumn("start_us", F.col("start_us") + TRACE_SHIFT)
    return ST.telemetry_status(V.requests(spark, sf_dir), spark, E0, 240, lookback_s=86400, spans=spans,
                               trace_retention_hours=48)


@register("empty_reason", with_views("requests") + f""",
grid AS (SELECT e.service, {S0} + r.range * {DAY} AS step_us FROM (VALUES {_SVC_VALUES}) e(service), range(1, 31) r),
sel AS (SELECT service, ts_us FROM requests WHERE {APP} AND status BETWEEN 500 AND 599),
ret AS (SELECT service, count(*) AS n FROM sel GROUP BY 1),
win AS (SELECT service, {S0} + CAST(ceil((ts_us - {S0}) / {DAY}) AS BIGINT) * {DAY} AS step_us, count(*) AS n
        FROM sel WHERE ts_us > {S0} AND ts_us <= {E0} GROUP BY 1, 2)
SELECT g.service, g.step_us,
  CASE WHEN coalesce(w.n, 0) > 0 THEN 'ok' WHEN coalesce(t.n, 0) = 0 THEN 'series_absent' ELSE 'no_samples_in_window' END AS reason,
  CASE WHEN coalesce(w.n, 0) > 0 THEN CAST(w.n AS DOUBLE) / 86400.0 ELSE 0.0 END AS value
FROM grid g LEFT JOIN win w ON w.service = g.service AND w.step_us = g.step_us LEFT JOIN ret t ON t.service = g.service""")
def q_empty_reason(spark, sf_dir):
    """error_rate per service and day with its emptiness reason."""
    out = ST.empty_reasons(V.requests(spark, sf_dir), "error_rate", _expected(spark), S0 + DAY, E0, DAY,
                           E0, (E0 - S0) / HOUR)
    rate = F.when(F.col("status") == "ok", F.col("in_window") / 86400.0).otherwise(F.col("value"))
    return out.select("service", "step_us", "reason", rate.cast("double").alias("value"))


@register("prom_or", with_views("requests") + f""",
l AS (SELECT service, {S0} + CAST(ceil((ts_us - {S0}) / {DAY}) AS BIGINT) * {DAY} AS step_us,
        count(*) / 86400.0 AS value FROM requests
      WHERE {APP} AND status BETWEEN 500 AND 599 AND ts_us > {S0 - DAY} AND ts_us <= {E0} GROUP BY 1, 2),
r AS (SELECT e.service, {S0} + g.range * {DAY} AS step_us, 0.0 AS value
      FROM (VALUES {_SVC_VALUES}) e(service), range(0, 31) g)
SELECT * FROM l UNION ALL
SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.service = r.service AND l.step_us = r.step_us)""")
def q_prom_or(spark, sf_dir):
    """`rate(5xx) or <zero vector per expected service>` as a set operation."""
    r = V.requests(spark, sf_dir).where(is_5xx("status"))
    left = R.red_series(r, S0, E0, DAY, DAY).select("service", "step_us",
                                                     F.col("request_rate").alias("value"))
    right = SR.step_grid(spark, _expected(spark), S0, E0, DAY).withColumn("value", F.lit(0.0))
    return ST.prom_or(left, right, ["service", "step_us"])


@register("series_exists", with_views("requests") + f"""
SELECT e.service, e.service IN (SELECT service FROM requests WHERE {APP} AND status BETWEEN 500 AND 599) AS exists
FROM (VALUES {_SVC_VALUES}, ('payments')) e(service)""")
def q_series_exists(spark, sf_dir):
    """Does the 5xx series of each expected service (plus one never seen) exist?"""
    exp = spark.createDataFrame([(s,) for s in SERVICES + ("payments",)], "service string")
    sel = V.requests(spark, sf_dir).where(app_routes("route") & is_5xx("status"))
    return ST.series_exists(exp, sel)


# --- Q-1 over the i1 window (2 days, dense points every 300 s, 12-point budget) ---
_I1 = V.INCIDENT_ROWS[0]
_WIN = Window(_I1[3], _I1[4])
_AS_OF = E0
_W0, _W1 = _I1[3], _I1[4]
_K = (_W1 - _W0) // 300000000

_Q1_BASE = f""",
steps AS (SELECT {_W0} + r.range * 300000000 AS t FROM range(0, {_K + 1}) r),
sel AS (SELECT * FROM requests_faulted WHERE {APP}),
hits AS (SELECT q.service, q.status, q.duration_ms, s.t FROM steps s JOIN sel q
         ON q.ts_us > s.t - 300000000 AND q.ts_us <= s.t),
present AS (SELECT DISTINCT service FROM hits),
grid AS (SELECT p.service, s.t FROM present p, steps s)"""

_SUMMARY = """SELECT service, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS avg,
  count(*) AS points, arg_min(step_us, (-value, step_us)) AS peak_at_us
FROM pts WHERE value IS NOT NULL GROUP BY service"""


def _series_out(df):
    cols = [c for c in df.columns if c not in ("min", "max", "avg")]
    extra = [r6(c).alias(c) for c in ("p50", "p95", "p99") if c in df.columns]
    base = [c for c in cols if c not in ("p50", "p95", "p99")]
    return df.select(*base, *extra, r6("min").alias("min"), r6("max").alias("max"), r6("avg").alias("avg"))


@register("query_metrics_request_rate", with_views("requests_faulted") + _Q1_BASE + """,
pts AS (SELECT g.service, g.t AS step_us, coalesce(h.n, 0) / 300.0 AS value FROM grid g
        LEFT JOIN (SELECT service, t, count(*) AS n FROM hits GROUP BY 1, 2) h ON h.service = g.service AND h.t = g.t)
""" + _SUMMARY)
def q_query_metrics_request_rate(spark, sf_dir):
    out = M.query_metrics(V.requests_faulted(spark, sf_dir), "request_rate", _WIN, _AS_OF,
                          retention_hours=24 * 30)
    return _series_out(out["series"])


_LAT = _Q1_BASE + f""",
hb AS (SELECT service, t AS step_us, {le_case()} AS le, count(*) AS n FROM hits GROUP BY 1, 2, 3),
""" + hq_ctes("stepq", "hb", "service, step_us", {"value": 0.95}) + """,
pts AS (SELECT g.service, g.t AS step_us, v.val AS value FROM grid g
        LEFT JOIN stepq v ON v.service = g.service AND v.step_us = g.t)"""


@register("query_metrics_latency_points", with_views("requests_faulted") + _LAT + """,
j AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY step_us) - 1 AS j,
        count(*) OVER (PARTITION BY service) AS n FROM pts)
SELECT service, CAST(CASE WHEN n <= 12 THEN j ELSE (12 * (j + 1) - 1) // n END AS INTEGER) AS bucket,
  min(step_us) AS bucket_start_us, round(max(value), 6) AS value FROM j GROUP BY 1, 2""")
def q_query_metrics_latency_points(spark, sf_dir):
    out = M.query_metrics(V.requests_faulted(spark, sf_dir), "latency", _WIN, _AS_OF,
                          retention_hours=24 * 30)
    return out["points"].withColumn("value", r6("value"))


@register("query_metrics_latency_series", with_views("requests_faulted") + _LAT + f""",
whole AS (SELECT service, {le_case()} AS le, count(*) AS n FROM sel
          WHERE ts_us > {_W0} AND ts_us <= {_W1} GROUP BY 1, 2),
""" + hq_ctes("headq", "whole", "service", {"p50": 0.5, "p95": 0.95, "p99": 0.99}) + """,
heads AS (SELECT service, max(CASE WHEN qname = 'p50' THEN val END) AS p50,
            max(CASE WHEN qname = 'p95' THEN val END) AS p95, max(CASE WHEN qname = 'p99' THEN val END) AS p99
          FROM headq GROUP BY service),
summ AS (SELECT service, min(value) AS mn, max(value) AS mx, avg(value) AS av, count(*) AS points,
           arg_min(step_us, (-value, step_us)) AS peak_at_us FROM pts WHERE value IS NOT NULL GROUP BY service)
SELECT s.service, s.points, s.peak_at_us, round(h.p50, 6) AS p50, round(h.p95, 6) AS p95, round(h.p99, 6) AS p99,
  round(s.mn, 6) AS min, round(s.mx, 6) AS max, round(s.av, 6) AS avg
FROM summ s LEFT JOIN heads h ON h.service = s.service""")
def q_query_metrics_latency_series(spark, sf_dir):
    out = M.query_metrics(V.requests_faulted(spark, sf_dir), "latency", _WIN, _AS_OF,
                          retention_hours=24 * 30)
    return _series_out(out["series"])


_I3 = V.INCIDENT_ROWS[2]
_K3 = (_I3[4] - _I3[3]) // 300000000


@register("query_metrics_db_pool", with_views("pool_gauge") + f""",
steps AS (SELECT {_I3[3]} + r.range * 300000000 AS t FROM range(0, {_K3 + 1}) r),
l AS (SELECT s.t, g.pool_name, g.state, arg_max(g.value, g.ts_us) AS value FROM steps s
      JOIN pool_gauge g ON g.ts_us > s.t - 300000000 AND g.ts_us <= s.t
      WHERE g.pool_name = 'inventory-pool' GROUP BY 1, 2, 3),
pts AS (SELECT state AS service, t AS step_us, sum(value) AS value FROM l GROUP BY 1, 2)
""" + _SUMMARY)
def q_query_metrics_db_pool(spark, sf_dir):
    out = M.query_metrics(V.requests_faulted(spark, sf_dir), "db_pool", Window(_I3[3], _I3[4]), _AS_OF,
                          service="inventory", gauges=V.pool_gauge(spark, sf_dir), retention_hours=24 * 30)
    return _series_out(out["series"])


_RAGGED = 64 * 1000000


@register("query_metrics_status", with_views("requests") + f""",
ends AS (SELECT max(ts_us) + 2000000 AS e FROM requests WHERE {APP} AND service = 'orders'),
rate AS (SELECT count(*) AS n FROM requests, ends WHERE {APP} AND service = 'orders'
         AND ts_us > e - {_RAGGED} - 30000000 AND ts_us <= e - {_RAGGED} + 60000000)
SELECT CASE WHEN n > 0 THEN 'ok' ELSE 'empty' END AS status, CASE WHEN n > 0 THEN 'ok' ELSE 'no_samples_in_window' END AS reason
FROM rate""")
def q_query_metrics_status(spark, sf_dir):
    """The status of a window of 64 s whose last request lies after its last point."""
    req = V.requests(spark, sf_dir)
    end = (R.application(req).where(F.col("service") == "orders").agg(F.max("ts_us")).first()[0] or 0) + 2000000
    out = M.query_metrics(req, "request_rate", Window(end - _RAGGED, end), end, service="orders", retention_hours=24 * 30)
    return out["status"].select("status", "reason")
