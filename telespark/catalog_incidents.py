"""Registered incident-scoring queries (O-25, O-54, O-55, O-66, O-67, Q-5, Q-6, Q-8, Q-9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import register, r6
from .config import SERVICES
from .operators import requests as R
from .operators import series as SR
from .operators.joins import interval_join
from .plans import scoring as SC
from .plans.oracle_views import APP, nearest_sql, with_views
from .sources import views as V

S0 = V.EPOCH_2024_US
E0 = V.EPOCH_2024_US + 30 * V.DAY_US
DAY = V.DAY_US
HOUR = V.HOUR_US
BS, BE = V.BASELINE_START_US, V.BASELINE_END_US
AS_OF = S0 + 31 * DAY                 # 2024-02-01
RETENTION_H = 21 * 24                 # horizon 2024-01-11: i1 expired, i2 clamped
_SVC_VALUES = ", ".join(f"('{s}')" for s in SERVICES)


@register("incident_join", with_views("requests_faulted", "incidents") + f"""
SELECT i.incident_id, r.service, count(*) AS requests,
  count(*) FILTER (WHERE r.status BETWEEN 500 AND 599) AS errors_5xx,
  round(avg(r.duration_ms), 6) AS avg_ms
FROM requests_faulted r JOIN incidents i ON r.ts_us BETWEEN i.start_us AND i.end_us
WHERE {APP} GROUP BY 1, 2""")
def q_incident_join(spark, sf_dir):
    """Requests inside each labelled window (inclusive range join)."""
    win = V.incidents(spark).select("incident_id", F.col("start_us").alias("w_start"),
                                    F.col("end_us").alias("w_end"))
    j = interval_join(R.application(V.requests_faulted(spark, sf_dir)), win, "ts_us", "w_start", "w_end", DAY)
    return j.groupBy("incident_id", "service").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("status").between(500, 599)).alias("errors_5xx"),
        F.round(F.avg("duration_ms"), 6).alias("avg_ms"))


_OBS = f"""obs AS (
  SELECT i.incident_id, count(r.request_id) AS requests_seen,
    count(r.request_id) FILTER (WHERE i.fault_type = 'latency') AS requests_delayed,
    count(r.request_id) FILTER (WHERE r.status BETWEEN 500 AND 599) AS requests_failed
  FROM incidents i LEFT JOIN (SELECT * FROM requests_faulted WHERE {APP}) r
    ON r.service = i.service AND r.ts_us BETWEEN i.start_us AND i.end_us
  GROUP BY 1)"""


@register("incident_observed", with_views("requests_faulted", "incidents") + ", " + _OBS + """
SELECT incident_id, requests_seen, requests_delayed, requests_failed,
  round(100.0 * requests_failed / nullif(requests_seen, 0), 6) AS failed_pct FROM obs""")
def q_incident_observed(spark, sf_dir):
    o = SC.incident_observed(V.requests_faulted(spark, sf_dir), V.incidents(spark))
    return o.select("incident_id", "requests_seen", "requests_delayed", "requests_failed",
                    r6("failed_pct").alias("failed_pct"))


_SIGNALS = f"""
st AS (SELECT service, duration_ms, status, {S0} + CAST(ceil((ts_us - {S0}) / {DAY}) AS BIGINT) * {DAY} AS step_us
       FROM requests_faulted WHERE {APP} AND ts_us > {S0 - DAY} AND ts_us <= {E0}),
pts AS (
  SELECT 'p95' AS metric, service, step_us, quantile_cont(duration_ms, 0.95) AS value FROM st GROUP BY 2, 3
  UNION ALL SELECT 'error_ratio', service, step_us,
    100.0 * count(*) FILTER (WHERE status BETWEEN 500 AND 599) / count(*) FROM st GROUP BY 2, 3
  UNION ALL SELECT 'request_rate', service, step_us, count(*) / 86400.0 FROM st GROUP BY 2, 3
  UNION ALL SELECT 'pool_' || state, 'inventory', t, sum(value) FROM (
    SELECT s.t, g.pool_name, g.state, arg_max(g.value, g.ts_us) AS value
    FROM (SELECT {S0} + r.range * {DAY} AS t FROM range(0, 31) r) s
    JOIN pool_gauge g ON g.ts_us > s.t - 300000000 AND g.ts_us <= s.t GROUP BY 1, 2, 3) gg GROUP BY 1, 2, 3),
base AS (SELECT metric, service, median(value) AS before FROM pts WHERE step_us BETWEEN {BS} AND {BE} GROUP BY 1, 2),
cw AS (SELECT c.*, i.service AS inc_service, i.fault_type,
         i.start_us + least(45000000, greatest(0, i.end_us - i.start_us - 30000000)) AS from_us, i.end_us AS to_us
       FROM checks c JOIN incidents i ON i.incident_id = c.incident_id),
dur AS (SELECT cw.incident_id, cw.name, p.value, p.step_us, b.before
        FROM cw JOIN pts p ON p.metric = cw.metric AND p.service = cw.service AND p.step_us BETWEEN cw.from_us AND cw.to_us
        LEFT JOIN base b ON b.metric = cw.metric AND b.service = cw.service WHERE p.value IS NOT NULL),
agg AS (SELECT incident_id, name, count(*) AS samples, max(value) AS mx, min(value) AS mn,
          arg_max(value, (CASE WHEN before IS NOT NULL THEN abs(value - before) ELSE value END, -step_us)) AS worst
        FROM dur GROUP BY 1, 2),
o AS (SELECT cw.*, b.before, coalesce(a.samples, 0) AS samples,
        CASE cw.expect WHEN 'rise' THEN a.mx WHEN 'fall' THEN a.mn ELSE a.worst END AS during
      FROM cw LEFT JOIN base b ON b.metric = cw.metric AND b.service = cw.service
      LEFT JOIN agg a ON a.incident_id = cw.incident_id AND a.name = cw.name)
SELECT regexp_extract(incident_id, '[^/]*$') AS incident, inc_service AS service, fault_type AS fault,
  name AS metric, expect, round(before, 6) AS before, round(during, 6) AS during, samples, unit,
  CASE WHEN before IS NULL OR during IS NULL THEN 'NO DATA'
       WHEN expect = 'rise' THEN CASE WHEN during - before >= min_delta THEN 'YES' ELSE 'NO' END
       WHEN expect = 'fall' THEN CASE WHEN before - during >= min_delta THEN 'YES' ELSE 'NO' END
       ELSE CASE WHEN abs(during - before) <= tolerance THEN 'FLAT' ELSE 'MOVED' END END AS verdict
FROM o"""


@register("signal_verdicts", with_views("requests_faulted", "incidents", "checks", "pool_gauge") + "," + _SIGNALS)
def q_signal_verdicts(spark, sf_dir):
    """Daily points (p95, error ratio, request rate) of the faulted requests, baseline
    median vs the extreme during each incident, one verdict per check."""
    pts = SC.signal_points(V.requests_faulted(spark, sf_dir), S0, E0, DAY, DAY,
                           gauges=V.pool_gauge(spark, sf_dir))
    v = SC.verify_signals(pts, V.incidents(spark), V.checks(spark), BS, BE)
    return v.select("incident", "service", "fault", "metric", "expect", r6("before").alias("before"),
                    r6("during").alias("during"), "samples", "unit", "verdict")


# two runs: i1 and i2, then i3 and i4 from the end of i2 on
_RUN = "CASE WHEN i.incident_id IN ('run-fx/i1', 'run-fx/i2') THEN 'a' ELSE 'b' END AS run_id"


@register("signal_verdicts_by_run", with_views("requests_faulted", "incidents", "checks", "pool_gauge") + f""",
runs AS (SELECT 'a' AS run_id, {S0} AS started_us UNION ALL SELECT 'b', {S0 + 11 * DAY}),
quiet AS (SELECT r.run_id, r.started_us + 15000000 AS q_start, min(i.start_us) - 15000000 AS q_end
          FROM runs r JOIN (SELECT start_us, {_RUN} FROM incidents i) i ON i.run_id = r.run_id GROUP BY r.run_id, r.started_us),"""
          + _SIGNALS.replace(f"base AS (SELECT metric, service, median(value) AS before FROM pts WHERE step_us BETWEEN {BS} AND {BE} GROUP BY 1, 2)",
                             "base AS (SELECT q.run_id, metric, service, median(value) AS before FROM pts JOIN quiet q "
                             "ON step_us BETWEEN q_start AND q_end GROUP BY 1, 2, 3)")
          .replace("SELECT c.*, i.service AS inc_service", f"SELECT c.*, {_RUN}, i.service AS inc_service")
          .replace("b.metric = cw.metric AND", "b.run_id = cw.run_id AND b.metric = cw.metric AND"))
def q_signal_verdicts_by_run(spark, sf_dir):
    """The checks against the quiet window of each incident's own run."""
    inc = V.incidents(spark).withColumn(
        "run_id", F.when(F.col("incident_id").isin("run-fx/i1", "run-fx/i2"), "a").otherwise("b"))
    runs = spark.createDataFrame([("a", S0), ("b", S0 + 11 * DAY)], "run_id string, started_us long")
    pts = SC.signal_points(V.requests_faulted(spark, sf_dir), S0, E0, DAY, DAY, gauges=V.pool_gauge(spark, sf_dir))
    v = SC.verify_signals(pts, inc, V.checks(spark), baselines=SC.baseline_windows(runs, inc))
    return v.select("incident", "service", "fault", "metric", "expect", r6("before").alias("before"),
                    r6("during").alias("during"), "samples", "unit", "verdict")


_H = AS_OF - RETENTION_H * 3600 * 1000000


@register("replay", with_views("requests_faulted", "incidents", "pool_gauge") + ", " + _OBS + f""",
lab AS (SELECT i.*, o.requests_seen, o.requests_failed,
          CASE fault_type WHEN 'latency' THEN 'latency' WHEN 'error_rate' THEN 'error_ratio'
               WHEN 'pool_exhaust' THEN 'db_pool' ELSE 'latency' END AS metric,
          i.end_us < {_H} AS expired, i.end_us >= {_H} AND i.start_us < {_H} AS clamped,
          greatest(i.start_us, {_H}) AS w_start, i.end_us AS w_end
        FROM incidents i JOIN obs o ON o.incident_id = i.incident_id),
lab2 AS (SELECT *,
   CAST(greatest(2.0, round_even(greatest(30.0, least(300.0, ((w_end - w_start) / 1e6) / 4.0)) / 15.0, 0)) * 15 AS BIGINT) AS rate_window_s,
   CAST(greatest(15, CAST(floor(((w_end - w_start) / 1e6) / 600 / 15 + 1) AS BIGINT) * 15) AS BIGINT) AS fetch_step_s
   FROM lab),
rws AS (SELECT l.incident_id, r.ts_us, r.status, l.w_start, l.w_end, l.rate_window_s, l.fetch_step_s
        FROM lab2 l JOIN requests_faulted r ON r.service = l.service
          AND r.ts_us > l.w_start - l.rate_window_s * 1000000 AND r.ts_us <= l.w_end
        WHERE NOT l.expired AND l.metric = 'error_ratio' AND {APP}),
stp AS (SELECT incident_id, status, unnest(generate_series(
          greatest(0, CAST(ceil((ts_us - w_start) / (fetch_step_s * 1000000)) AS BIGINT)),
          least(CAST(floor((w_end - w_start) / (fetch_step_s * 1000000)) AS BIGINT),
                CAST(ceil((ts_us - w_start + rate_window_s * 1000000) / (fetch_step_s * 1000000)) AS BIGINT) - 1))) AS k
        FROM rws),
per_step AS (SELECT incident_id, k, count(*) AS n, count(*) FILTER (WHERE status BETWEEN 500 AND 599) AS e
             FROM stp GROUP BY 1, 2),
ratio AS (SELECT incident_id, max(100.0 * e / n) AS measured_max, sum(e) AS errors FROM per_step GROUP BY 1),
seen AS (SELECT l.incident_id, count(*) AS nrows FROM lab2 l JOIN requests_faulted r ON r.service = l.service
           AND r.ts_us BETWEEN l.w_start AND l.w_end WHERE NOT l.expired AND {APP} GROUP BY 1),
g AS (SELECT l.incident_id, count(*) AS grows FROM lab2 l JOIN pool_gauge p ON p.ts_us BETWEEN l.w_start AND l.w_end
      WHERE NOT l.expired AND l.metric = 'db_pool' GROUP BY 1),
o AS (SELECT l.*, r.measured_max,
        CASE WHEN expired THEN 'EXPIRED'
             WHEN NOT (CASE WHEN metric = 'error_ratio' THEN coalesce(r.errors, 0) > 0
                            WHEN metric = 'db_pool' THEN coalesce(g.grows, 0) > 0
                            ELSE coalesce(s.nrows, 0) > 0 END) THEN 'EMPTY' ELSE 'ok' END AS status,
        CASE WHEN requests_seen > 0 THEN 100.0 * requests_failed / requests_seen END AS labelled_pct
      FROM lab2 l LEFT JOIN ratio r ON r.incident_id = l.incident_id LEFT JOIN seen s ON s.incident_id = l.incident_id
      LEFT JOIN g ON g.incident_id = l.incident_id)
SELECT incident_id, fault_type, service, metric, status, clamped, w_start AS window_start_us, w_end AS window_end_us,
  rate_window_s, fetch_step_s, round(labelled_pct, 6) AS labelled_pct,
  round(CASE WHEN status = 'ok' THEN measured_max END, 6) AS measured_max,
  CASE WHEN status <> 'ok' THEN status
       WHEN metric = 'error_ratio' AND labelled_pct IS NOT NULL THEN
         CASE WHEN abs(measured_max - labelled_pct) <= 6.0 THEN 'MATCH' ELSE 'MISMATCH' END
       ELSE 'reported' END AS verdict,
  CASE WHEN expired THEN {_H} END AS oldest_available_us
FROM o""")
def q_replay(spark, sf_dir):
    req = V.requests_faulted(spark, sf_dir)
    inc = V.incidents(spark)
    labels = inc.join(SC.incident_observed(req, inc).select("incident_id", "requests_seen", "requests_failed"),
                      "incident_id")
    out = SC.replay(req, labels, AS_OF, RETENTION_H, gauges=V.pool_gauge(spark, sf_dir))
    return out.withColumn("labelled_pct", r6("labelled_pct")).withColumn("measured_max", r6("measured_max"))


_RECOVERY = f"""
door AS (SELECT * FROM requests_faulted WHERE {APP} AND service = 'gateway'),
bdoor AS (SELECT * FROM door WHERE ts_us BETWEEN {BS} AND {BE}),
base AS ({nearest_sql("bdoor", "", "duration_ms", {"baseline_p95_ms": 0.95})}),
probes AS (SELECT * FROM (
  SELECT i.incident_id, i.end_us AS at_us, d.ts_us, d.duration_ms, d.status,
    row_number() OVER (PARTITION BY i.incident_id ORDER BY d.ts_us, d.request_id) AS rk
  FROM incidents i JOIN door d ON d.ts_us > i.end_us) x WHERE rk <= 10),
pp AS ({nearest_sql("probes", "incident_id", "duration_ms", {"probe_p95_ms": 0.95})}),
agg AS (SELECT incident_id, count(*) AS probes,
          count(*) FILTER (WHERE NOT coalesce(status = 200, false)) AS probe_failures,
          (max(ts_us) - max(at_us)) / 1e6 AS recovery_s FROM probes GROUP BY 1),
busy AS (SELECT DISTINCT a.incident_id FROM incidents a JOIN incidents b
         ON b.incident_id <> a.incident_id AND a.end_us BETWEEN b.start_us AND b.end_us)
SELECT i.incident_id, coalesce(agg.probes, 0) AS probes, coalesce(agg.probe_failures, 0) AS probe_failures,
  pp.probe_p95_ms, greatest(400.0, 4.0 * base.baseline_p95_ms) AS probe_ceiling_ms,
  busy.incident_id IS NULL AS inert,
  (coalesce(agg.probes, 0) >= 10 AND busy.incident_id IS NULL AND coalesce(agg.probe_failures, 0) = 0
   AND coalesce(pp.probe_p95_ms <= greatest(400.0, 4.0 * base.baseline_p95_ms), false)) AS recovered,
  CASE WHEN coalesce(agg.probes, 0) < 10 THEN 'too few probes' WHEN recovered THEN 'recovered' ELSE 'not recovered' END AS state,
  agg.recovery_s
FROM incidents i LEFT JOIN agg ON agg.incident_id = i.incident_id LEFT JOIN pp ON pp.incident_id = i.incident_id
LEFT JOIN busy ON busy.incident_id = i.incident_id, base"""


@register("recovery", with_views("requests_faulted", "incidents") + "," + _RECOVERY)
def q_recovery(spark, sf_dir):
    return SC.verify_recovery(V.requests_faulted(spark, sf_dir), V.incidents(spark), BS, BE)


@register("recovery_short_tail", with_views("requests_faulted", "incidents") + """,
door_ts AS (SELECT ts_us, row_number() OVER (ORDER BY ts_us DESC, request_id DESC) AS rk FROM requests_faulted
            WHERE route NOT LIKE '/chaos%' AND route <> '/health' AND service = 'gateway'),
tails AS (SELECT incident_id, service, fault_type, start_us, CASE incident_id WHEN 'run-fx/i1' THEN (SELECT ts_us FROM door_ts WHERE rk = 4)
            WHEN 'run-fx/i2' THEN (SELECT max(ts_us) FROM door_ts) ELSE end_us END AS end_us FROM incidents),"""
          + _RECOVERY.replace("FROM incidents", "FROM tails").replace("JOIN incidents", "JOIN tails"))
def q_recovery_short_tail(spark, sf_dir):
    """Incidents that end three requests before the last one of the front door, and at it."""
    req = V.requests_faulted(spark, sf_dir)
    door = R.application(req).where(F.col("service") == "gateway")
    last = [r.ts_us for r in door.orderBy(F.col("ts_us").desc(), F.col("request_id").desc()).select("ts_us").limit(4).collect()]
    end = (F.when(F.col("incident_id") == "run-fx/i1", F.lit(last[3])).when(F.col("incident_id") == "run-fx/i2", F.lit(last[0]))
           .otherwise(F.col("end_us")))
    return SC.verify_recovery(req, V.incidents(spark).withColumn("end_us", end), BS, BE)


@register("annotated_requests", with_views("requests_faulted", "incidents") + f""",
ann AS (SELECT incident_id, (start_us // 1000) * 1000 AS a_start, (end_us // 1000) * 1000 AS a_end FROM incidents),
pts AS (SELECT service, ts_us // {HOUR} * {HOUR} AS step_us FROM requests_faulted WHERE {APP})
SELECT p.service, p.step_us, coalesce((SELECT string_agg(a.incident_id, ',' ORDER BY a.incident_id) FROM ann a
  WHERE p.step_us BETWEEN a.a_start AND a.a_end), '') AS incidents FROM pts p""")
def q_annotated_requests(spark, sf_dir):
    """Every request as a point at its hour, equal points kept, with the incidents that cover it."""
    pts = R.application(V.requests_faulted(spark, sf_dir)).select(
        "service", (F.floor(F.col("ts_us") / HOUR) * HOUR).cast("bigint").alias("step_us"))
    return SC.annotate(pts, V.incidents(spark))


@register("annotated_series", with_views("requests_faulted", "incidents") + f""",
grid AS (SELECT s.service, {S0} + r.range * {HOUR} AS step_us
         FROM (VALUES {_SVC_VALUES}) s(service), range(0, {(E0 - S0) // HOUR + 1}) r),
cnt AS (SELECT service, {S0} + CAST(ceil((ts_us - {S0}) / {HOUR}) AS BIGINT) * {HOUR} AS step_us, count(*) AS n
        FROM requests_faulted WHERE {APP} AND ts_us > {S0 - HOUR} AND ts_us <= {E0} GROUP BY 1, 2),
pts AS (SELECT g.service, g.step_us, coalesce(c.n, 0) AS value FROM grid g
        LEFT JOIN cnt c ON c.service = g.service AND c.step_us = g.step_us),
ann AS (SELECT incident_id, (start_us // 1000) * 1000 AS a_start, (end_us // 1000) * 1000 AS a_end
        FROM incidents WHERE fault_type = 'latency' OR service = 'latency')
SELECT p.service, p.step_us, p.value, coalesce(string_agg(a.incident_id, ',' ORDER BY a.incident_id), '') AS incidents
FROM pts p LEFT JOIN ann a ON p.step_us BETWEEN a.a_start AND a.a_end GROUP BY 1, 2, 3""")
def q_annotated_series(spark, sf_dir):
    """Hourly request counts per service, each point carrying the latency incidents
    (tags must include 'chaos' and 'latency') that cover it."""
    counts = R.red_series(V.requests_faulted(spark, sf_dir), S0, E0, HOUR, HOUR).select(
        "service", "step_us", F.col("requests").alias("value"))
    exp = spark.createDataFrame([(s,) for s in SERVICES], "service string")
    pts = SR.zero_fill(counts, SR.step_grid(spark, exp, S0, E0, HOUR), ["service", "step_us"], ["value"])
    return SC.annotate(pts, V.incidents(spark), ("chaos", "latency"))
