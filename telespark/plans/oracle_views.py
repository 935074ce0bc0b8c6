"""DuckDB SQL for the fixture views, used only by the oracle side of the checks.

Each `oracle_sql()` entry is `WITH <views> <query>`; the views mirror
telespark.sources.views exactly.
"""

from ..sources.views import (CHECK_ROWS, INCIDENT_ROWS, SPAN_INCIDENT_ROWS,
                             BUCKET_BOUNDS_MS)


def _values(rows):
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        return f"CAST({v} AS BIGINT)"
    return ",\n  ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


REQUESTS = """requests AS (
  SELECT event_id AS request_id, epoch_us(ts) AS ts_us,
    CASE user_id % 3 WHEN 0 THEN 'gateway' WHEN 1 THEN 'orders' ELSE 'inventory' END AS service,
    CASE WHEN event_id % 20 = 0 THEN '/health' WHEN event_id % 20 = 1 THEN '/chaos/latency'
         WHEN user_id % 3 = 0 THEN '/api/orders' WHEN user_id % 3 = 1 THEN '/orders' ELSE '/reserve' END AS route,
    CAST(CASE WHEN event_id % 20 = 1 THEN 501 WHEN event_type = 'error' THEN 500 ELSE 200 END AS INTEGER) AS status,
    value AS duration_ms
  FROM events)"""

REQUESTS_FAULTED = """requests_faulted AS (
  SELECT request_id, ts_us, service, route,
    CAST(CASE WHEN service IN ('orders','gateway') AND route NOT LIKE '/chaos%' AND route <> '/health'
          AND ts_us BETWEEN 1704844800000000 AND 1705017600000000 AND request_id % 5 = 2 THEN 500
         WHEN status = 500 THEN 200 ELSE status END AS INTEGER) AS status,
    duration_ms + CASE WHEN route LIKE '/chaos%' OR route = '/health' THEN 0.0
         WHEN ts_us BETWEEN 1704412800000000 AND 1704585600000000 THEN 400.0
         WHEN service = 'gateway' AND ts_us BETWEEN 1705708800000000 AND 1705881600000000 THEN 250.0
         ELSE 0.0 END AS duration_ms
  FROM requests)"""

SPANS = """spans AS (
  WITH n AS (
    SELECT l.*, epoch_us(o.o_orderdate) AS order_us,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
        l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS n
    FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey)
  SELECT l_orderkey AS trace_id, CAST(n AS BIGINT) AS span_id,
    CASE WHEN n = 1 THEN NULL ELSE CAST(n // 2 AS BIGINT) END AS parent_span_id,
    CASE WHEN n = 1 THEN 'gateway' WHEN n <= 3 THEN 'orders' ELSE 'inventory' END AS service,
    order_us + (l_orderkey % 86400) * 1000000 + (n - 1) * 7000 AS start_us,
    CAST(l_quantity AS BIGINT) * 1000 + CASE WHEN n = 1 THEN 60000 ELSE 0 END AS duration_us,
    CAST(CASE WHEN l_returnflag = 'R' AND n > 3 THEN 500 ELSE 200 END AS INTEGER) AS status
  FROM n)"""

COUNTERS = """counters AS (
  WITH e AS (SELECT service, route, status, (ts_us - 1704067200000000) // 3600000000 AS h, count(*) AS n
             FROM requests GROUP BY 1, 2, 3, 4),
  k AS (SELECT service, route, status, min(h) AS first_h FROM e GROUP BY 1, 2, 3),
  g AS (SELECT k.service, k.route, k.status, r.range AS h FROM k, range(0, 720) r WHERE r.range >= k.first_h),
  f AS (SELECT g.service, g.route, g.status, g.h, coalesce(e.n, 0) AS n FROM g
        LEFT JOIN e ON e.service = g.service AND e.route = g.route AND e.status = g.status AND e.h = g.h)
  SELECT service, route, status, 1704067200000000 + (h + 1) * 3600000000 AS ts_us,
    CAST(sum(n) OVER (PARTITION BY service, route, status, h // 360 ORDER BY h
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS value
  FROM f)"""


def bucket_counts_sql(source="requests", step_us=3600000000, start_us=1704067200000000):
    le = " ".join(f"WHEN duration_ms <= {b!r} THEN CAST({b!r} AS DOUBLE)" for b in BUCKET_BOUNDS_MS)
    return f"""bucket_counts AS (
  SELECT service, route, {start_us} + CAST(ceil((ts_us - {start_us}) / {step_us}) AS BIGINT) * {step_us} AS step_us,
    CASE {le} ELSE CAST('Infinity' AS DOUBLE) END AS le, count(*) AS n
  FROM {source} GROUP BY 1, 2, 3, 4)"""


INCIDENTS = f"""incidents AS (
  SELECT * FROM (VALUES
  {_values(INCIDENT_ROWS)}) AS t(incident_id, service, fault_type, start_us, end_us))"""

SPAN_INCIDENTS = f"""span_incidents AS (
  SELECT * FROM (VALUES
  {_values(SPAN_INCIDENT_ROWS)}) AS t(incident_id, service, fault_type, start_us, end_us))"""

CHECKS = f"""checks AS (
  SELECT * FROM (VALUES
  {_values(CHECK_ROWS)}) AS t(incident_id, name, metric, service, expect, min_delta, tolerance, unit))"""

SELF_TIME = """resolved AS (
  SELECT s.*, p.span_id AS parent_id FROM spans s
  LEFT JOIN spans p ON p.trace_id = s.trace_id AND p.span_id = s.parent_span_id),
cov AS (
  SELECT trace_id, parent_id AS span_id,
    sum(greatest(0, end_us - greatest(start_us, coalesce(prev, start_us)))) AS covered_us
  FROM (SELECT trace_id, parent_id, start_us, start_us + duration_us AS end_us,
          max(start_us + duration_us) OVER (PARTITION BY trace_id, parent_id ORDER BY start_us, span_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
        FROM resolved WHERE parent_id IS NOT NULL) c
  GROUP BY 1, 2),
selfs AS (
  SELECT r.*, greatest(0, r.duration_us - coalesce(cov.covered_us, 0)) AS self_us,
    (r.status >= 500) AS is_error
  FROM resolved r LEFT JOIN cov ON cov.trace_id = r.trace_id AND cov.span_id = r.span_id)"""

FOLD = """folded AS (
  SELECT t.trace_id, t.root_span_id, t.root_service, t.start_us, t.duration_us, t.spans, t.errors,
    t.root_status, s.self_us_by_service
  FROM (SELECT trace_id,
          arg_min(span_id, (parent_id IS NOT NULL, start_us, span_id)) AS root_span_id,
          arg_min(service, (parent_id IS NOT NULL, start_us, span_id)) AS root_service,
          arg_min(start_us, (parent_id IS NOT NULL, start_us, span_id)) AS start_us,
          arg_min(duration_us, (parent_id IS NOT NULL, start_us, span_id)) AS duration_us,
          count(*) AS spans, count(*) FILTER (WHERE is_error) AS errors,
          arg_min(status, (parent_id IS NOT NULL, start_us, span_id)) AS root_status
        FROM selfs GROUP BY trace_id) t
  JOIN (SELECT trace_id, string_agg(service || '=' || CAST(s AS VARCHAR), ';' ORDER BY service) AS self_us_by_service
        FROM (SELECT trace_id, service, sum(self_us) AS s FROM selfs GROUP BY 1, 2) x GROUP BY trace_id) s
  ON s.trace_id = t.trace_id)"""


POOL_GAUGE = """pool_gauge AS (
  WITH c AS (SELECT (ts_us - 1704067200000000) // 3600000000 AS h, count(*) AS n
             FROM requests WHERE service = 'inventory' GROUP BY 1),
  u AS (SELECT 1704067200000000 + (g.range + 1) * 3600000000 AS ts_us,
          least(coalesce(c.n, 0) + CASE WHEN 1704067200000000 + (g.range + 1) * 3600000000
                BETWEEN 1705276800000000 AND 1705449600000000 THEN 9 ELSE 0 END, 10) AS used
        FROM range(0, 720) g LEFT JOIN c ON c.h = g.range)
  SELECT 'inventory-pool' AS pool_name, 'used' AS state, ts_us, CAST(used AS DOUBLE) AS value FROM u
  UNION ALL
  SELECT 'inventory-pool', 'idle', ts_us, CAST(10 - used AS DOUBLE) FROM u)"""

POOL_PENDING = """pool_pending AS (
  SELECT 'inventory-pool' AS pool_name, 1704067200000000 + (h + 1) * 3600000000 AS ts_us,
    CAST(greatest(n - 10, 0) AS DOUBLE) AS value
  FROM (SELECT (ts_us - 1704067200000000) // 3600000000 AS h, count(*) AS n
        FROM requests WHERE service = 'inventory' GROUP BY 1))"""

JVM_MEMORY = """jvm_memory AS (
  WITH p AS (SELECT service, 1704067200000000 + ((ts_us - 1704067200000000) // 3600000000 + 1) * 3600000000 AS ts_us,
               count(*) AS n, sum(CAST(round(duration_ms) AS BIGINT)) AS d
             FROM requests GROUP BY 1, 2)
  SELECT service, 'heap' AS area, 'eden' AS pool, ts_us, CAST(n * 1048576 AS DOUBLE) AS value FROM p
  UNION ALL SELECT service, 'heap', 'old', ts_us, CAST(d * 1024 AS DOUBLE) FROM p
  UNION ALL SELECT service, 'nonheap', 'metaspace', ts_us, 67108864.0 FROM p)"""

PIPELINE = """pipeline_counters AS (
  WITH p AS (SELECT (ts_us - 1704067200000000) // 3600000000 AS h, count(*) AS accepted,
               count(*) FILTER (WHERE NOT (route LIKE '/chaos%' OR route = '/health')) AS sent,
               count(*) FILTER (WHERE route LIKE '/chaos%' OR route = '/health') AS refused
             FROM requests GROUP BY 1),
  l AS (SELECT h, 'otelcol_receiver_accepted_spans' AS name, accepted AS n FROM p
        UNION ALL SELECT h, 'otelcol_exporter_sent_spans', sent FROM p
        UNION ALL SELECT h, 'otelcol_receiver_refused_spans', refused FROM p)
  SELECT name, 1704067200000000 + (h + 1) * 3600000000 AS ts_us,
    CAST(sum(n) OVER (PARTITION BY name ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS value
  FROM l)"""


def with_views(*names: str) -> str:
    """`WITH` prefix holding the named views (dependencies included, in order)."""
    deps = {"requests_faulted": ["requests"], "counters": ["requests"],
            "selfs": ["spans"], "folded": ["spans", "selfs"], "pool_gauge": ["requests"],
            "pool_pending": ["requests"], "jvm_memory": ["requests"],
            "pipeline_counters": ["requests"], "bucket_counts": ["requests"]}
    bodies = {"requests": REQUESTS, "requests_faulted": REQUESTS_FAULTED, "spans": SPANS,
              "counters": COUNTERS, "incidents": INCIDENTS, "span_incidents": SPAN_INCIDENTS,
              "checks": CHECKS, "selfs": SELF_TIME, "folded": FOLD, "pool_gauge": POOL_GAUGE,
              "pool_pending": POOL_PENDING, "jvm_memory": JVM_MEMORY,
              "pipeline_counters": PIPELINE, "bucket_counts": bucket_counts_sql()}
    order = []

    def add(n):
        for d in deps.get(n, []):
            add(d)
        if n not in order:
            order.append(n)
    for n in names:
        add(n)
    return "WITH " + ",\n".join(bodies[n] for n in order) + "\n"

# application-route predicate in DuckDB (fully anchored, missing route passes)
APP = "NOT regexp_full_match(coalesce(route, ''), '/health|/chaos.*')"


def nearest_sql(table: str, keys: str, value: str, fractions: dict) -> str:
    """sorted[min(n-1, floor(n*f))] per key group, as SQL over `table`."""
    cols = ", ".join(
        f"max(CASE WHEN rn - 1 = least(n - 1, CAST(floor(n * CAST({f!r} AS DOUBLE)) AS BIGINT)) THEN {value} END) AS {name}"
        for name, f in fractions.items())
    part = f"PARTITION BY {keys}" if keys else ""
    sel = f"{keys}, " if keys else ""
    grp = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {sel}{cols} FROM (
  SELECT *, row_number() OVER ({part} ORDER BY {value}) AS rn, count(*) OVER ({part}) AS n FROM {table}) z {grp}"""


def dense_buckets_sql(name: str, src: str, group: str) -> str:
    """CTE `{name}`: every group of `src` x every configured bound (+Inf), empty
    buckets with n = 0 (as a histogram store keeps them)."""
    gcols = [g.strip() for g in group.split(",")]
    bv = ", ".join(f"(CAST({b!r} AS DOUBLE))" for b in BUCKET_BOUNDS_MS) + ", (CAST('Infinity' AS DOUBLE))"
    on = " AND ".join(f"s.{g} = gg.{g}" for g in gcols)
    return f"""{name} AS (SELECT {', '.join('gg.' + g for g in gcols)}, bb.le, coalesce(s.n, 0) AS n
  FROM (SELECT DISTINCT {group} FROM {src}) gg CROSS JOIN (VALUES {bv}) bb(le)
  LEFT JOIN {src} s ON {on} AND s.le = bb.le)"""


def hq_ctes(name: str, src: str, group: str, qs: dict) -> str:
    """CTEs ending in `{name}` (group..., qname, val): Prometheus histogram_quantile
    over `src` (group..., le, n) with non-cumulative per-bucket counts; the buckets
    are densified over the configured bounds first."""
    gq = ", ".join(f"h.{g.strip()}" for g in group.split(","))
    qv = ", ".join(f"('{n}', CAST({q!r} AS DOUBLE))" for n, q in qs.items())
    return dense_buckets_sql(f"{name}_dense", src, group) + f""",
{name}_c AS (SELECT {group}, le, sum(n) OVER (PARTITION BY {group} ORDER BY le ROWS UNBOUNDED PRECEDING) AS cum FROM {name}_dense),
{name}_h AS (SELECT {group}, le, cum, coalesce(lag(cum) OVER w, 0) AS prev_cum, lag(le) OVER w AS prev_le,
        max(cum) OVER (PARTITION BY {group}) AS total FROM {name}_c WINDOW w AS (PARTITION BY {group} ORDER BY le)),
{name}_q AS (SELECT * FROM (VALUES {qv}) t(qname, q)),
{name}_hit AS (SELECT h.*, qq.qname, qq.q * h.total AS rnk,
          row_number() OVER (PARTITION BY {gq}, qq.qname ORDER BY h.le) AS rk
        FROM {name}_h h JOIN {name}_q qq ON h.cum >= qq.q * h.total WHERE h.total > 0),
{name} AS (SELECT {group}, qname, CASE WHEN le = CAST('Infinity' AS DOUBLE) THEN prev_le
          WHEN prev_le IS NULL AND le <= 0 THEN le WHEN cum = prev_cum THEN le
          ELSE coalesce(prev_le, 0.0) + (le - coalesce(prev_le, 0.0)) * ((rnk - prev_cum) / (cum - prev_cum)) END AS val
      FROM {name}_hit WHERE rk = 1)"""


def le_case(col: str = "duration_ms") -> str:
    return "CASE " + " ".join(f"WHEN {col} <= {b!r} THEN CAST({b!r} AS DOUBLE)" for b in BUCKET_BOUNDS_MS) \
        + " ELSE CAST('Infinity' AS DOUBLE) END"
