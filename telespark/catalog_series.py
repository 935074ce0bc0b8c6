"""Registered series, counter, histogram and gauge queries
(O-32, O-36, O-43..O-45, O-57, O-58, O-62)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import register, r6
from .config import SERVICES
from .functions.predicates import app_routes, is_5xx, label_eq
from .operators import counters as C
from .operators import requests as R
from .operators import series as SR
from .plans.oracle_views import APP, hq_ctes, le_case, with_views
from .sources import views as V

S0 = V.EPOCH_2024_US
E0 = V.EPOCH_2024_US + 30 * V.DAY_US
DAY = V.DAY_US
HOUR = V.HOUR_US
SIX_H = 6 * HOUR
_SVC_VALUES = ", ".join(f"('{s}')" for s in SERVICES)


def r9(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 9)


def _expected(spark):
    return spark.createDataFrame([(s,) for s in SERVICES], "service string")


@register("sliding_rate", with_views("requests") + f""",
steps AS (SELECT {S0} + r.range * {SIX_H} AS step_us FROM range(0, {(E0 - S0) // SIX_H + 1}) r)
SELECT r.service, s.step_us, count(*) AS requests, count(*) / 86400.0 AS request_rate
FROM steps s JOIN requests r ON r.ts_us > s.step_us - {DAY} AND r.ts_us <= s.step_us
WHERE {APP} GROUP BY 1, 2""")
def q_sliding_rate(spark, sf_dir):
    """1-day range evaluated every 6 h: each request is assigned to its 4 steps
    (explode of a bounded sequence) and grouped; no range join."""
    s = R.red_series(V.requests(spark, sf_dir), S0, E0, SIX_H, DAY)
    return s.select("service", "step_us", "requests", "request_rate")


_HOURLY_PTS = f"""grid AS (SELECT s.service, {S0} + r.range * {HOUR} AS step_us
            FROM (VALUES {_SVC_VALUES}) s(service), range(0, {(E0 - S0) // HOUR + 1}) r),
cnt AS (SELECT service, {S0} + CAST(ceil((ts_us - {S0}) / {HOUR}) AS BIGINT) * {HOUR} AS step_us, count(*) AS n
        FROM requests WHERE {APP} AND ts_us > {S0 - HOUR} AND ts_us <= {E0} GROUP BY 1, 2),
pts AS (SELECT g.service, g.step_us, coalesce(c.n, 0) AS value FROM grid g
        LEFT JOIN cnt c ON c.service = g.service AND c.step_us = g.step_us)"""


def _hourly_points(spark, sf_dir):
    counts = R.red_series(V.requests(spark, sf_dir), S0, E0, HOUR, HOUR).select(
        "service", "step_us", F.col("requests").alias("value"))
    grid = SR.step_grid(spark, _expected(spark), S0, E0, HOUR)
    return SR.zero_fill(counts, grid, ["service", "step_us"], ["value"])


@register("downsample_max", with_views("requests") + ", " + _HOURLY_PTS + """,
j AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY step_us) - 1 AS j,
        count(*) OVER (PARTITION BY service) AS n FROM pts)
SELECT service, CAST(CASE WHEN n <= 12 THEN j ELSE (12 * (j + 1) - 1) // n END AS INTEGER) AS bucket,
  min(step_us) AS bucket_start_us, max(value) AS value
FROM j GROUP BY 1, 2""")
def q_downsample_max(spark, sf_dir):
    return SR.downsample_max(_hourly_points(spark, sf_dir), ["service"]).select(
        "service", "bucket", "bucket_start_us", "value")


@register("panel_summaries", with_views("requests") + ", " + _HOURLY_PTS + """
SELECT service, round(arg_max(value, step_us) / 3600.0, 9) AS last, round(avg(value) / 3600.0, 9) AS mean,
  round(max(value) / 3600.0, 9) AS max
FROM pts GROUP BY service""")
def q_panel_summaries(spark, sf_dir):
    pts = _hourly_points(spark, sf_dir).withColumn("value", F.col("value") / 3600.0)
    s = SR.last_non_null(pts, ["service"])
    return s.select("service", r9("last").alias("last"), r9("mean").alias("mean"), r9("max").alias("max"))


@register("zero_filled_errors", with_views("requests") + f""",
grid AS (SELECT s.service, {S0} + r.range * {DAY} AS step_us
         FROM (VALUES {_SVC_VALUES}) s(service), range(0, 31) r),
e AS (SELECT service, {S0} + CAST(ceil((ts_us - {S0}) / {DAY}) AS BIGINT) * {DAY} AS step_us, count(*) AS n
      FROM requests WHERE {APP} AND status BETWEEN 500 AND 599 AND ts_us > {S0 - DAY} AND ts_us <= {E0} GROUP BY 1, 2)
SELECT g.service, g.step_us, coalesce(e.n, 0) AS errors_5xx, coalesce(e.n, 0) / 86400.0 AS error_rate
FROM grid g LEFT JOIN e ON e.service = g.service AND e.step_us = g.step_us""")
def q_zero_filled_errors(spark, sf_dir):
    r = V.requests(spark, sf_dir).where(is_5xx("status"))
    errs = R.red_series(r, S0, E0, DAY, DAY).select("service", "step_us", F.col("requests").alias("errors_5xx"))
    grid = SR.step_grid(spark, _expected(spark), S0, E0, DAY)
    out = SR.zero_fill(errs, grid, ["service", "step_us"], ["errors_5xx"])
    return out.withColumn("error_rate", F.col("errors_5xx") / 86400.0)


_HQ = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def _hq_sql(group: str) -> str:
    qs = ", ".join(f"('{n}', CAST({q!r} AS DOUBLE))" for n, q in _HQ.items())
    cols = ", ".join(f"round(max(CASE WHEN name = '{n}' THEN val END), 6) AS {n}" for n in _HQ)
    from .plans.oracle_views import dense_buckets_sql
    return dense_buckets_sql("bd", "b", group) + f""",
c AS (SELECT {group}, le, sum(n) OVER (PARTITION BY {group} ORDER BY le ROWS UNBOUNDED PRECEDING) AS cum FROM bd),
h AS (SELECT {group}, le, cum, coalesce(lag(cum) OVER w, 0) AS prev_cum, lag(le) OVER w AS prev_le,
        max(cum) OVER (PARTITION BY {group}) AS total FROM c WINDOW w AS (PARTITION BY {group} ORDER BY le)),
qs AS (SELECT * FROM (VALUES {qs}) t(name, q)),
hit AS (SELECT h.*, qs.name, qs.q * h.total AS rnk,
          row_number() OVER (PARTITION BY {', '.join('h.' + g.strip() for g in group.split(','))}, qs.name ORDER BY h.le) AS rk
        FROM h JOIN qs ON h.cum >= qs.q * h.total WHERE h.total > 0),
v AS (SELECT {group}, name, CASE WHEN le = CAST('Infinity' AS DOUBLE) THEN prev_le
          WHEN prev_le IS NULL AND le <= 0 THEN le WHEN cum = prev_cum THEN le
          ELSE coalesce(prev_le, 0.0) + (le - coalesce(prev_le, 0.0)) * ((rnk - prev_cum) / (cum - prev_cum)) END AS val
      FROM hit WHERE rk = 1)
SELECT {group}, {cols} FROM v GROUP BY {group}"""


@register("histogram_quantile", with_views("bucket_counts") + f""",
b AS (SELECT service, le, sum(n) AS n FROM bucket_counts WHERE {APP} GROUP BY 1, 2),
""" + _hq_sql("service"))
def q_histogram_quantile(spark, sf_dir):
    """Window-wide p50/p95/p99 in ms per service from histogram buckets
    (`sum by (le, service)` then histogram_quantile)."""
    b = V.bucket_counts(V.requests(spark, sf_dir)).where(app_routes("route"))
    per_le = b.groupBy("service", "le").agg(F.sum("n").alias("n"))
    cum = C.cumulative_buckets(per_le, ["service"], bounds=V.BUCKET_BOUNDS_MS)
    q = C.histogram_quantile(cum, ["service"], _HQ)
    return q.select("service", *[r6(n).alias(n) for n in _HQ])


@register("histogram_p95_daily", with_views("requests") + ", " +
          __import__("telespark.plans.oracle_views", fromlist=["x"]).bucket_counts_sql(step_us=DAY).replace(
              "bucket_counts AS", "daily_buckets AS") + f""",
b AS (SELECT service, step_us, le, sum(n) AS n FROM daily_buckets WHERE {APP} GROUP BY 1, 2, 3),
""" + _hq_sql("service, step_us"))
def q_histogram_p95_daily(spark, sf_dir):
    b = V.bucket_counts(V.requests(spark, sf_dir), step_us=DAY).where(app_routes("route"))
    per_le = b.groupBy("service", "step_us", "le").agg(F.sum("n").alias("n"))
    cum = C.cumulative_buckets(per_le, ["service", "step_us"], bounds=V.BUCKET_BOUNDS_MS)
    q = C.histogram_quantile(cum, ["service", "step_us"], _HQ)
    return q.select("service", "step_us", *[r6(n).alias(n) for n in _HQ])


_DELTAS = f"""d AS (SELECT service, route, status, ts_us, value, lag(ts_us) OVER w AS prev_ts, lag(value) OVER w AS prev_v
      FROM counters WINDOW w AS (PARTITION BY service, route, status ORDER BY ts_us)),
dd AS (SELECT *, CASE WHEN prev_v IS NULL THEN 0.0 WHEN value >= prev_v THEN value - prev_v ELSE value END AS delta
       FROM d WHERE {APP})"""


@register("counter_increase", with_views("counters") + ", " + _DELTAS + """
SELECT service, CAST(sum(delta) AS BIGINT) AS increase FROM dd WHERE status BETWEEN 500 AND 599 GROUP BY service""")
def q_counter_increase(spark, sf_dir):
    """Reset-aware 5xx increase per service on application routes (counter birth = 0)."""
    keys = ["service", "route", "status"]
    d = C.counter_deltas(V.counters(spark, sf_dir), keys)
    d = d.where(app_routes("route") & is_5xx("status"))
    inc = C.increase_exact(d, ["service"], 0, 2 ** 62)
    return inc.select("service", F.col("increase").cast("bigint").alias("increase"))


@register("counter_rate_promql", with_views("counters") + ", " + _DELTAS + f""",
steps AS (SELECT {S0} + r.range * {DAY} AS t FROM range(0, 31) r),
g AS (SELECT s.t, dd.service, dd.route, dd.status, count(*) AS n, min(ts_us) AS t0, max(ts_us) AS t1,
        arg_min(value, ts_us) AS v0, sum(CASE WHEN prev_ts > s.t - {DAY} THEN delta ELSE 0.0 END) AS inc
      FROM steps s JOIN dd ON dd.ts_us > s.t - {DAY} AND dd.ts_us <= s.t GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2),
e AS (SELECT *, (t1 - t0) / 1e6 AS sampled, (t0 - (t - {DAY})) / 1e6 AS to_start0, (t - t1) / 1e6 AS to_end FROM g),
e2 AS (SELECT *, sampled / (n - 1) AS avg_gap,
         CASE WHEN inc > 0 AND v0 >= 0 AND sampled * (v0 / inc) < to_start0 THEN sampled * (v0 / inc) ELSE to_start0 END AS to_start
       FROM e),
r AS (SELECT service, t AS step_us, inc * ((sampled + CASE WHEN to_start < avg_gap * 1.1 THEN to_start ELSE avg_gap / 2 END
        + CASE WHEN to_end < avg_gap * 1.1 THEN to_end ELSE avg_gap / 2 END) / sampled) AS increase FROM e2)
SELECT service, step_us, round(sum(increase), 6) AS increase, round(sum(increase) / 86400.0, 9) AS rate
FROM r GROUP BY 1, 2""")
def q_counter_rate_promql(spark, sf_dir):
    """`sum by (service)(rate(count{{app}}[1d]))` every day, PromQL extrapolation."""
    keys = ["service", "route", "status"]
    d = C.counter_deltas(V.counters(spark, sf_dir), keys).where(app_routes("route"))
    r = C.rate_series(d, keys, S0, E0, DAY, DAY, mode="promql")
    g = r.groupBy("service", "step_us").agg(F.sum("increase").alias("increase"))
    return g.select("service", "step_us", r6("increase").alias("increase"),
                    r9(F.col("increase") / 86400.0).alias("rate"))


@register("gauge_by_state", with_views("pool_gauge") + f""",
steps AS (SELECT {S0} + r.range * {DAY} AS t FROM range(0, 31) r),
l AS (SELECT s.t, g.pool_name, g.state, arg_max(g.value, g.ts_us) AS value
      FROM steps s JOIN pool_gauge g ON g.ts_us > s.t - 300000000 AND g.ts_us <= s.t GROUP BY 1, 2, 3)
SELECT state, t AS step_us, sum(value) AS value FROM l WHERE pool_name = 'inventory-pool' GROUP BY 1, 2""")
def q_gauge_by_state(spark, sf_dir):
    """`sum by (state)(db_client_connections_usage{{pool_name="inventory-pool"}})` daily."""
    g = label_eq(V.pool_gauge(spark, sf_dir), pool_name="inventory-pool")
    s = C.gauge_series(g, ["pool_name", "state"], S0, E0, DAY)
    return s.groupBy("state", "step_us").agg(F.sum("value").alias("value"))


_ACC, _SENT, _REF = ("otelcol_receiver_accepted_spans", "otelcol_exporter_sent_spans",
                     "otelcol_receiver_refused_spans")


@register("pipeline_loss", with_views("pipeline_counters") + f""",
d AS (SELECT name, ts_us, CASE WHEN lag(value) OVER w IS NULL THEN 0.0 WHEN value >= lag(value) OVER w
        THEN value - lag(value) OVER w ELSE value END AS delta
      FROM pipeline_counters WINDOW w AS (PARTITION BY name ORDER BY ts_us)),
r AS (SELECT name, {S0} + CAST(ceil((ts_us - {S0}) / {DAY}) AS BIGINT) * {DAY} AS step_us, sum(delta) / 86400.0 AS rate
      FROM d WHERE ts_us > {S0 - DAY} AND ts_us <= {E0} GROUP BY 1, 2)
SELECT step_us, round(max(rate) FILTER (WHERE name = '{_ACC}'), 9) AS accepted_rate,
  round(max(rate) FILTER (WHERE name = '{_SENT}'), 9) AS sent_rate,
  round(max(rate) FILTER (WHERE name = '{_REF}'), 9) AS refused_rate,
  round(max(rate) FILTER (WHERE name = '{_ACC}') - max(rate) FILTER (WHERE name = '{_SENT}'), 9) AS loss_rate
FROM r GROUP BY step_us""")
def q_pipeline_loss(spark, sf_dir):
    d = C.counter_deltas(V.pipeline_counters(spark, sf_dir), ["name"])
    r = C.rate_series(d, ["name"], S0, E0, DAY, DAY, mode="exact")
    p = r.groupBy("step_us").agg(*[F.max(F.when(F.col("name") == n, F.col("rate"))).alias(a)
                                   for n, a in ((_ACC, "acc"), (_SENT, "sent"), (_REF, "ref"))])
    return p.select("step_us", r9("acc").alias("accepted_rate"), r9("sent").alias("sent_rate"),
                    r9("ref").alias("refused_rate"), r9(F.col("acc") - F.col("sent")).alias("loss_rate"))


_LE_COLS = ", ".join(f"count(*) FILTER (WHERE duration_ms <= {b!r}) AS le_{str(b).replace('.', '_')}"
                     for b in V.BUCKET_BOUNDS_MS)


@register("red_rollup", with_views("requests") + f"""
SELECT (ts_us // {HOUR}) * {HOUR} AS window_start_us, (ts_us // {HOUR}) * {HOUR} + {HOUR} AS window_end_us,
  service, count(*) AS requests, count(*) FILTER (WHERE status BETWEEN 500 AND 599) AS errors_5xx, {_LE_COLS}
FROM requests WHERE {APP} GROUP BY 1, 2, 3""")
def q_red_rollup(spark, sf_dir):
    """Batch twin of the streaming RED rollup (event-time tumbling windows of 1 h)."""
    from .streaming.red import red_rollup, with_event_time
    return red_rollup(with_event_time(V.requests(spark, sf_dir)), "1 hour")


@register("dashboard_panels", with_views("requests", "pool_gauge", "pipeline_counters") + f""",
steps AS (SELECT {S0} + r.range * {HOUR} AS t FROM range(0, {(E0 - S0) // HOUR + 1}) r),
st AS (SELECT *, {S0} + CAST(ceil((ts_us - {S0}) / {HOUR}) AS BIGINT) * {HOUR} AS step_us FROM requests
       WHERE ts_us > {S0 - HOUR} AND ts_us <= {E0}),
cnt AS (SELECT service, step_us, count(*) AS n FROM st WHERE {APP} GROUP BY 1, 2),
grid AS (SELECT p.service, s.t AS step_us FROM (SELECT DISTINCT service FROM cnt) p, steps s),
rate AS (SELECT 'request_rate' AS panel, g.service AS series, g.step_us, coalesce(c.n, 0) / 3600.0 AS value
         FROM grid g LEFT JOIN cnt c ON c.service = g.service AND c.step_us = g.step_us),
hb AS (SELECT service, step_us, {le_case()} AS le, count(*) AS n FROM st WHERE {APP} GROUP BY 1, 2, 3),
""" + hq_ctes("pq", "hb", "service, step_us", {"value": 0.95}) + f""",
p95 AS (SELECT 'p95_ms' AS panel, service AS series, step_us, val AS value FROM pq),
errs AS (SELECT 'errors_5xx' AS panel, service AS series, step_us, count(*) / 3600.0 AS value FROM st
         WHERE coalesce(route, '') NOT LIKE '/chaos%' AND status BETWEEN 500 AND 599 GROUP BY 1, 2, 3),
pool AS (SELECT 'pool' AS panel, state AS series, t AS step_us, sum(value) AS value FROM (
           SELECT s.t, g.pool_name, g.state, arg_max(g.value, g.ts_us) AS value FROM steps s
           JOIN pool_gauge g ON g.ts_us > s.t - 300000000 AND g.ts_us <= s.t
           WHERE g.pool_name = 'inventory-pool' GROUP BY 1, 2, 3) x GROUP BY 1, 2, 3),
d AS (SELECT name, ts_us, CASE WHEN lag(value) OVER w IS NULL THEN 0.0 WHEN value >= lag(value) OVER w
        THEN value - lag(value) OVER w ELSE value END AS delta
      FROM pipeline_counters WINDOW w AS (PARTITION BY name ORDER BY ts_us)),
pipe AS (SELECT 'pipeline' AS panel, name AS series, {S0} + CAST(ceil((ts_us - {S0}) / {HOUR}) AS BIGINT) * {HOUR} AS step_us,
           sum(delta) / 3600.0 AS value FROM d WHERE ts_us > {S0 - HOUR} AND ts_us <= {E0} GROUP BY 1, 2, 3),
allp AS (SELECT * FROM rate UNION ALL SELECT * FROM p95 UNION ALL SELECT * FROM errs
         UNION ALL SELECT * FROM pool UNION ALL SELECT * FROM pipe)
SELECT panel, series, round(arg_max(value, step_us), 9) AS last, round(avg(value), 9) AS mean,
  round(max(value), 9) AS max
FROM allp WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY 1, 2""")
def q_dashboard_panels(spark, sf_dir):
    """Five panels (request rate, p95, 5xx, pool, pipeline) at hourly steps."""
    from .plans.dashboard import dashboard_panels
    d = dashboard_panels(V.requests(spark, sf_dir), S0, E0, HOUR,
                         pool_gauge=V.pool_gauge(spark, sf_dir), pipeline=V.pipeline_counters(spark, sf_dir))
    return d.select("panel", "series", r9("last").alias("last"), r9("mean").alias("mean"), r9("max").alias("max"))


_HALF = HOUR // 2
_STEPS_30M = f"SELECT {S0} + r.range * {_HALF} AS t FROM range(0, {(E0 - S0) // _HALF + 1}) r"


@register("dashboard_ranges", with_views("requests", "pool_gauge", "pool_pending", "jvm_memory") + f""",
steps AS ({_STEPS_30M}),
short AS (SELECT s.t AS step_us, q.* FROM steps s JOIN requests q ON q.ts_us > s.t - {HOUR} AND q.ts_us <= s.t),
long AS (SELECT s.t AS step_us, q.* FROM steps s JOIN requests q ON q.ts_us > s.t - {5 * HOUR} AND q.ts_us <= s.t
         WHERE {APP}),
cnt AS (SELECT service, step_us, count(*) AS n FROM short WHERE {APP} GROUP BY 1, 2),
grid AS (SELECT p.service, s.t AS step_us FROM (SELECT DISTINCT service FROM cnt) p, steps s),
rate AS (SELECT 'request_rate' AS panel, g.service AS series, g.step_us, coalesce(c.n, 0) / 3600.0 AS value
         FROM grid g LEFT JOIN cnt c ON c.service = g.service AND c.step_us = g.step_us),
hb AS (SELECT service, step_us, {le_case()} AS le, count(*) AS n FROM long GROUP BY 1, 2, 3),
""" + hq_ctes("pq", "hb", "service, step_us", {"value": 0.95}) + f""",
errs AS (SELECT 'errors_5xx' AS panel, service AS series, step_us, count(*) / 3600.0 AS value FROM short
         WHERE coalesce(route, '') NOT LIKE '/chaos%' AND status BETWEEN 500 AND 599 GROUP BY 1, 2, 3),
pool AS (SELECT 'pool' AS panel, state AS series, t AS step_us, sum(value) AS value FROM (
           SELECT s.t, g.pool_name, g.state, arg_max(g.value, g.ts_us) AS value FROM steps s
           JOIN pool_gauge g ON g.ts_us > s.t - 300000000 AND g.ts_us <= s.t GROUP BY 1, 2, 3) x GROUP BY 1, 2, 3),
pend AS (SELECT 'pool' AS panel, 'pending' AS series, s.t AS step_us, arg_max(g.value, g.ts_us) AS value
         FROM steps s JOIN pool_pending g ON g.ts_us > s.t - 300000000 AND g.ts_us <= s.t GROUP BY 3),
heap AS (SELECT 'heap' AS panel, service AS series, t AS step_us, sum(value) AS value FROM (
           SELECT s.t, g.service, g.pool, arg_max(g.value, g.ts_us) AS value FROM steps s
           JOIN jvm_memory g ON g.ts_us > s.t - 300000000 AND g.ts_us <= s.t
           WHERE g.area = 'heap' GROUP BY 1, 2, 3) x GROUP BY 1, 2, 3),
allp AS (SELECT * FROM rate UNION ALL SELECT 'p95_ms', service, step_us, val FROM pq UNION ALL SELECT * FROM errs
         UNION ALL SELECT * FROM pool UNION ALL SELECT * FROM pend UNION ALL SELECT * FROM heap)
SELECT panel, series, round(arg_max(value, step_us), 9) AS last, round(avg(value), 6) AS mean,
  round(max(value), 9) AS max
FROM allp WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY 1, 2""")
def q_dashboard_ranges(spark, sf_dir):
    """The dashboard with ranges apart from the step (rates over 1 h, p95 over 5 h, every
    30 min: the proportions of 1 m and 5 m at 30 s), pending requests and heap by service."""
    from .plans.dashboard import dashboard_panels
    d = dashboard_panels(V.requests(spark, sf_dir), S0, E0, _HALF, pool_gauge=V.pool_gauge(spark, sf_dir),
                         pending=V.pool_pending(spark, sf_dir), heap=V.jvm_memory(spark, sf_dir),
                         rate_range_us=HOUR, quantile_range_us=5 * HOUR)
    return d.select("panel", "series", r9("last").alias("last"), r6("mean").alias("mean"), r9("max").alias("max"))


@register("sliding_rollup", with_views("requests") + f""",
w AS (SELECT r.range * {2 * HOUR} + (SELECT (min(ts_us) // {2 * HOUR}) * {2 * HOUR} - {4 * HOUR} FROM requests) AS a
      FROM range(0, (SELECT (max(ts_us) - min(ts_us)) // {2 * HOUR} + 5 FROM requests)) r)
SELECT a AS window_start_us, a + {5 * HOUR} AS window_end_us, service, count(*) AS requests,
  count(*) FILTER (WHERE status BETWEEN 500 AND 599) AS errors_5xx, {_LE_COLS}
FROM w JOIN requests ON ts_us >= a AND ts_us < a + {5 * HOUR} WHERE {APP} GROUP BY 1, 2, 3""")
def q_sliding_rollup(spark, sf_dir):
    """Batch twin of the sliding streaming rollup: windows of 5 h every 2 h, from panes of 1 h."""
    from .streaming.red import red_rollup, with_event_time
    return red_rollup(with_event_time(V.requests(spark, sf_dir)), "5 hours", "2 hours")


@register("rollup_daily_p95", with_views("requests") + f""",
b AS (SELECT service, (ts_us // {DAY}) * {DAY} AS day_us, {le_case()} AS le, count(*) AS n
      FROM requests WHERE {APP} GROUP BY 1, 2, 3),
""" + hq_ctes("dq", "b", "service, day_us", {"p95": 0.95}) + """
SELECT service, day_us, round(val, 6) AS p95 FROM dq""")
def q_rollup_daily_p95(spark, sf_dir):
    """Daily p95 per service merged from hourly streaming-style rollups."""
    from .streaming.red import red_rollup, rollup_quantiles, with_event_time
    hourly = red_rollup(with_event_time(V.requests(spark, sf_dir)), "1 hour")
    daily = hourly.withColumn("day_us", F.floor(F.col("window_start_us") / DAY).cast("bigint") * DAY)
    q = rollup_quantiles(daily, ["service", "day_us"], {"p95": 0.95})
    return q.select("service", "day_us", r6("p95").alias("p95"))


@register("silent_stretches", with_views("requests") + f""",
nxt AS (SELECT service, ts_us, lead(ts_us) OVER (PARTITION BY service ORDER BY ts_us) AS later
        FROM requests WHERE service IS NOT NULL AND ts_us <= {E0})
SELECT service, ts_us AS last_seen_us, ts_us + 300000000 AS silent_after_us FROM nxt
WHERE coalesce(later, {E0}) - ts_us > 300000000""")
def q_silent_stretches(spark, sf_dir):
    """Every stretch of more than five minutes without a request of a service."""
    from .streaming.red import silent_stretches
    return silent_stretches(V.requests(spark, sf_dir), E0)
