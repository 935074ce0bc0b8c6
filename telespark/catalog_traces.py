"""Registered trace queries (O-24, O-46..O-49, O-56, O-64, O-65, O-68, O-69, O-71, Q-2, Q-3, Q-7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import register, r6
from .operators import spans as S
from .operators.quantiles import exact_percentiles
from .plans import traces as T
from .plans import scoring
from .plans.oracle_views import with_views
from .sources import views as V

# fixed window for the trace queries: the span time domain of the fixture
TRACE_WINDOW = (788918400000000, 1000000000000000)   # 1995-01-01 .. 2001-09-09


def _selfs(spark, sf_dir):
    return S.self_time(V.spans_table(spark, sf_dir))


@register("fold_traces", with_views("folded") + "SELECT * FROM folded")
def q_fold_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fold_traces(_selfs(spark, sf_dir))


@register("trace_service_self", with_views("selfs") + """
SELECT trace_id, service, CAST(sum(self_us) AS BIGINT) AS self_us, count(*) AS spans
FROM selfs GROUP BY 1, 2""")
def q_trace_service_self(spark, sf_dir):
    return S.trace_service_self(S.self_time(V.spans_table(spark, sf_dir), resolve=False))


@register("trace_duration_stats", with_views("folded") + """
SELECT count(*) AS traces,
  round(quantile_cont(duration_us / 1000.0, 0.5), 6) AS p50_ms,
  round(quantile_cont(duration_us / 1000.0, 0.95), 6) AS p95_ms,
  round(max(duration_us) / 1000.0, 6) AS max_ms
FROM folded""")
def q_trace_duration_stats(spark, sf_dir):
    f = S.fold_traces(_selfs(spark, sf_dir)).select((F.col("duration_us") / 1000.0).alias("ms"))
    # max is the 100th percentile: one distributed pass gives count, p50, p95 and max
    p = exact_percentiles(f, [], "ms", {"p50_ms": 0.5, "p95_ms": 0.95, "max_ms": 1.0}, count_col="traces",
                          passes=1)   # the folded traces are derived: read them once
    return p.select("traces", r6("p50_ms").alias("p50_ms"), r6("p95_ms").alias("p95_ms"),
                    r6("max_ms").alias("max_ms"))


_S0, _S1 = TRACE_WINDOW


@register("sample_traces", with_views("folded") + f"""
SELECT trace_id, slice, start_us, duration_us, spans, errors FROM (
  SELECT *, row_number() OVER (PARTITION BY slice ORDER BY start_us DESC, trace_id) AS rn FROM (
    SELECT *, CAST(least(2, floor((start_us - {_S0}) * 3 / {_S1 - _S0})) AS INTEGER) AS slice
    FROM folded WHERE start_us >= {_S0} AND start_us < {_S1} AND root_service = 'gateway') a) b
WHERE rn <= 6""")
def q_sample_traces(spark, sf_dir):
    """The traces are picked by their roots; only those are folded."""
    picked, sampled = S.sampled_spans(V.spans_table(spark, sf_dir), _S0, _S1, 20, "gateway")
    return S.fold_traces(S.self_time(sampled)).join(picked, "trace_id").select("trace_id", "slice", "start_us", "duration_us", "spans", "errors")


@register("trace_top", with_views("folded") + """
SELECT trace_id, duration_us, spans, errors, self_us_by_service FROM folded
ORDER BY duration_us DESC, trace_id LIMIT 20""")
def q_trace_top(spark, sf_dir):
    f = S.fold_traces(_selfs(spark, sf_dir))
    return S.top_traces(f, 20).select("trace_id", "duration_us", "spans", "errors", "self_us_by_service")


@register("span_offsets", with_views("selfs") + """
SELECT s.trace_id, s.span_id, s.start_us - o.origin_us AS offset_us FROM selfs s
JOIN (SELECT trace_id, arg_min(start_us, (parent_id IS NOT NULL, start_us)) AS origin_us
      FROM selfs GROUP BY 1) o ON o.trace_id = s.trace_id""")
def q_span_offsets(spark, sf_dir):
    return S.span_offsets(_selfs(spark, sf_dir)).select("trace_id", "span_id", "offset_us")


@register("span_cap", with_views("spans") + """
SELECT trace_id, span_id, max(rn) OVER (PARTITION BY trace_id) > 60 AS truncated FROM (
  SELECT trace_id, span_id, row_number() OVER (PARTITION BY trace_id ORDER BY start_us, span_id) AS rn
  FROM spans) x QUALIFY rn <= 60""")
def q_span_cap(spark, sf_dir):
    return S.cap_spans(V.spans_table(spark, sf_dir), 60).select("trace_id", "span_id", "truncated")


_TREE_SQL = with_views("selfs").replace("WITH ", "WITH RECURSIVE ", 1) + """,
ranked AS (
  SELECT s.*, s.start_us - o.origin_us AS offset_us,
    CAST(s.start_us AS VARCHAR) || ':' || CAST(s.span_id AS VARCHAR) AS comp
  FROM selfs s JOIN (SELECT trace_id, arg_min(start_us, (parent_id IS NOT NULL, start_us)) AS origin_us
                     FROM selfs GROUP BY 1) o ON o.trace_id = s.trace_id),
tree AS (
  SELECT trace_id, span_id, 0 AS depth, comp AS path, offset_us, duration_us, self_us, service, status
  FROM ranked WHERE parent_id IS NULL
  UNION ALL
  SELECT c.trace_id, c.span_id, t.depth + 1, t.path || '/' || c.comp,
    c.offset_us, c.duration_us, c.self_us, c.service, c.status
  FROM ranked c JOIN tree t ON c.trace_id = t.trace_id AND c.parent_id = t.span_id)
SELECT * FROM tree"""


@register("trace_tree", _TREE_SQL)
def q_trace_tree(spark, sf_dir):
    path = F.array_join(F.transform("path", lambda p: F.concat_ws(":", p["start_us"], p["span_id"])), "/")
    return T.trace_tree(V.spans_table(spark, sf_dir)).withColumn("path", path).select(
        "trace_id", "span_id", "depth", "path", "offset_us", "duration_us", "self_us", "service", "status")


@register("trace_preorder", _TREE_SQL.replace("SELECT * FROM tree", """,
ranks AS (SELECT s.trace_id, s.span_id, row_number() OVER (PARTITION BY trace_id, parent_id ORDER BY start_us, span_id) AS k FROM selfs s),
walk AS (
  SELECT t.trace_id, t.span_id, [r.k] AS way, t.depth FROM tree t JOIN ranks r USING (trace_id, span_id) WHERE t.depth = 0
  UNION ALL
  SELECT s.trace_id, s.span_id, list_append(w.way, r.k), w.depth + 1
  FROM walk w JOIN selfs s ON s.trace_id = w.trace_id AND s.parent_id = w.span_id
  JOIN ranks r ON r.trace_id = s.trace_id AND r.span_id = s.span_id)
SELECT trace_id, span_id, depth, row_number() OVER (PARTITION BY trace_id ORDER BY way) - 1 AS position FROM walk"""))
def q_trace_preorder(spark, sf_dir):
    """Depth and place in the preorder of every span, by subtree sizes."""
    return T.trace_preorder(V.spans_table(spark, sf_dir)).select("trace_id", "span_id", "depth", "position")


# --- traces against incident windows (span time domain) ---------------------------

_IN_WINDOW = """traced AS (
  SELECT i.incident_id, f.* FROM folded f JOIN span_incidents i
  ON f.start_us BETWEEN i.start_us AND i.end_us WHERE f.root_service = 'gateway')"""


@register("evidence_index", with_views("folded", "span_incidents") + ", " + _IN_WINDOW + """
SELECT incident_id, 'gateway' AS root_service, count(*) AS traces, CAST(sum(spans) AS BIGINT) AS spans
FROM traced GROUP BY incident_id""")
def q_evidence_index(spark, sf_dir):
    return scoring.evidence_index(V.spans_table(spark, sf_dir), V.span_incidents(spark), "gateway")


# one more evidence window than labels: its row must be an ORPHAN
_EVIDENCE = """evidence AS (
  SELECT incident_id, start_us, end_us FROM span_incidents
  UNION ALL SELECT 'unlabelled-' || incident_id, start_us, end_us FROM span_incidents WHERE fault_type = 'pool_exhaust')"""


@register("dominance", with_views("selfs", "folded", "span_incidents") + ", " + _EVIDENCE + ", "
          + _IN_WINDOW.replace("span_incidents", "evidence") + """,
per AS (
  SELECT t.incident_id, s.service, sum(s.self_us) AS self_us
  FROM traced t JOIN selfs s ON s.trace_id = t.trace_id GROUP BY 1, 2),
shares AS (
  SELECT incident_id, service, 100.0 * self_us / sum(self_us) OVER (PARTITION BY incident_id) AS pct,
    row_number() OVER (PARTITION BY incident_id ORDER BY self_us DESC, service) AS rk FROM per),
top AS (SELECT incident_id, service AS top_service, pct AS top_pct FROM shares WHERE rk = 1),
n AS (SELECT incident_id, count(*) AS traces FROM traced GROUP BY 1)
SELECT e.incident_id, i.fault_type, i.service, coalesce(n.traces, 0) AS traces, top.top_service,
  round(top.top_pct, 6) AS top_pct, coalesce(i.fault_type = 'latency', false) AS asserted,
  CASE WHEN i.fault_type IS NULL THEN 'ORPHAN' WHEN i.fault_type <> 'latency' THEN 'info'
       WHEN top.top_service = i.service AND top.top_pct >= 85.0 THEN 'ok' ELSE 'FAIL' END AS verdict
FROM evidence e LEFT JOIN span_incidents i ON i.incident_id = e.incident_id
LEFT JOIN n ON n.incident_id = e.incident_id LEFT JOIN top ON top.incident_id = e.incident_id""")
def q_dominance(spark, sf_dir):
    labels = V.span_incidents(spark)
    extra = (labels.where(F.col("fault_type") == "pool_exhaust")
             .withColumn("incident_id", F.concat(F.lit("unlabelled-"), "incident_id")))
    out = scoring.verify_dominance(V.spans_table(spark, sf_dir), labels, labels.unionByName(extra), "gateway")
    return out.select("incident_id", "fault_type", "service", "traces", "top_service",
                      r6("top_pct").alias("top_pct"), "asserted", "verdict")


@register("payload_reduction", with_views("folded", "span_incidents", "selfs") + ", " + _IN_WINDOW + """,
raw AS (
  SELECT t.incident_id, sum(strlen(CAST(to_json({'traceID': CAST(s.trace_id AS VARCHAR), 'spanID': CAST(s.span_id AS VARCHAR),
    'operationName': s.service, 'startTime': s.start_us, 'duration': s.duration_us,
    'references': CASE WHEN s.parent_span_id IS NULL THEN [] ELSE
      [{'refType': 'CHILD_OF', 'spanID': CAST(s.parent_span_id AS VARCHAR)}] END,
    'tags': [{'key': 'http.response.status_code', 'value': s.status}]}) AS VARCHAR))) AS raw_bytes
  FROM traced t JOIN selfs s ON s.trace_id = t.trace_id GROUP BY 1),
served AS (
  SELECT incident_id, sum(strlen(CAST(to_json({'trace_id': CAST(trace_id AS VARCHAR), 'duration_us': duration_us, 'spans': spans,
    'errors': errors, 'self_us': self_us_by_service}) AS VARCHAR))) AS served_bytes
  FROM traced GROUP BY 1)
SELECT r.incident_id, CAST(r.raw_bytes AS BIGINT) AS raw_bytes, CAST(s.served_bytes AS BIGINT) AS served_bytes,
  round(r.raw_bytes / s.served_bytes, 6) AS reduction,
  CAST(r.raw_bytes // 4 AS BIGINT) AS raw_tokens, CAST(s.served_bytes // 4 AS BIGINT) AS served_tokens
FROM raw r JOIN served s ON s.incident_id = r.incident_id""")
def q_payload_reduction(spark, sf_dir):
    out = scoring.payload_reduction(V.spans_table(spark, sf_dir), V.span_incidents(spark), "gateway")
    return out.select("incident_id", "raw_bytes", "served_bytes", r6("reduction").alias("reduction"),
                      "raw_tokens", "served_tokens")


@register("query_traces_summary", with_views("folded") + f""",
sample AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY slice ORDER BY start_us DESC, trace_id) AS rn FROM (
      SELECT *, least(2, floor((start_us - {_S0}) * 3 / {_S1 - _S0})) AS slice
      FROM folded WHERE start_us >= {_S0} AND start_us < {_S1} AND root_service = 'gateway') a) b
  WHERE rn <= 6)
SELECT count(*) AS sampled, count(*) AS returned, round(max(duration_us / 1000.0), 6) AS max_ms,
  round(quantile_cont(duration_us / 1000.0, 0.5), 6) AS p50_ms,
  round(quantile_cont(duration_us / 1000.0, 0.95), 6) AS p95_ms
FROM sample""")
def q_query_traces_summary(spark, sf_dir):
    res = T.query_traces(V.spans_table(spark, sf_dir), "gateway", _S0, _S1, limit=20)
    return res["summary"].select("sampled", "returned", r6("max_ms").alias("max_ms"),
                                 r6("p50_ms").alias("p50_ms"), r6("p95_ms").alias("p95_ms"))


@register("query_traces_self_time", with_views("folded", "selfs") + f""",
sample AS (
  SELECT trace_id FROM (
    SELECT *, row_number() OVER (PARTITION BY slice ORDER BY start_us DESC, trace_id) AS rn FROM (
      SELECT *, least(2, floor((start_us - {_S0}) * 3 / {_S1 - _S0})) AS slice
      FROM folded WHERE start_us >= {_S0} AND start_us < {_S1} AND root_service = 'gateway') a) b
  WHERE rn <= 6),
per AS (SELECT service, sum(self_us) AS total_us FROM selfs WHERE trace_id IN (SELECT trace_id FROM sample) GROUP BY 1)
SELECT service, CAST(total_us AS BIGINT) AS total_us, round(100.0 * total_us / sum(total_us) OVER (), 6) AS pct FROM per""")
def q_query_traces_self_time(spark, sf_dir):
    res = T.query_traces(V.spans_table(spark, sf_dir), "gateway", _S0, _S1, limit=20)
    return res["self_time"].select("service", "total_us", r6("pct").alias("pct"))


@register("fold_operations", with_views("folded") + """
SELECT trace_id, root_service, CASE WHEN root_service = 'gateway' THEN 'POST /api/' || (trace_id % 5) ELSE root_service || '.handle' END
    AS root_operation,
  CASE WHEN root_service = 'gateway' THEN '/api/' || (trace_id % 5) END AS root_route, duration_us, spans FROM folded""")
def q_fold_operations(spark, sf_dir):
    """Which endpoint started a trace: operation and route of its root."""
    front = F.col("service") == "gateway"
    route = F.concat(F.lit("/api/"), (F.col("trace_id") % 5).cast("string"))
    spans = (V.spans_table(spark, sf_dir)
             .withColumn("operation", F.when(front, F.concat(F.lit("POST "), route)).otherwise(F.concat("service", F.lit(".handle"))))
             .withColumn("route", F.when(front, route)))
    return S.fold_traces(S.self_time(spans)).select("trace_id", "root_service", "root_operation", "root_route", "duration_us", "spans")


@register("evidence_confirmed", with_views("folded", "span_incidents") + """
SELECT i.incident_id, 'gateway' AS root_service, count(*) AS traces, CAST(sum(f.spans) AS BIGINT) AS spans
FROM folded f JOIN span_incidents i ON f.start_us BETWEEN CASE i.fault_type WHEN 'latency' THEN i.start_us + 864000000000 ELSE i.start_us END
  AND CASE i.fault_type WHEN 'latency' THEN i.end_us - 432000000000 ELSE i.end_us END
WHERE f.root_service = 'gateway' GROUP BY i.incident_id""")
def q_evidence_confirmed(spark, sf_dir):
    """Evidence of the confirmed bounds where a label has them (ten days later, five earlier)."""
    slow = F.col("fault_type") == "latency"
    labels = (V.span_incidents(spark).withColumn("confirmed_start_us", F.when(slow, F.col("start_us") + 10 * V.DAY_US))
              .withColumn("confirmed_end_us", F.when(slow, F.col("end_us") - 5 * V.DAY_US)))
    return scoring.evidence_index(V.spans_table(spark, sf_dir), labels, "gateway")


@register("query_traces_any", with_views("folded", "spans") + f""",
touching AS (SELECT DISTINCT trace_id FROM spans WHERE service = 'inventory'),
sample AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY slice ORDER BY start_us DESC, trace_id) AS rn FROM (
      SELECT *, least(2, floor((start_us - {_S0}) * 3 / {_S1 - _S0})) AS slice
      FROM folded WHERE start_us >= {_S0} AND start_us < {_S1} AND trace_id IN (SELECT trace_id FROM touching)) a) b
  WHERE rn <= 13)
SELECT trace_id, start_us, duration_us, spans, errors, root_service, self_us_by_service FROM sample
WHERE errors > 0 AND duration_us >= 80000""")
def q_query_traces_any(spark, sf_dir):
    """Slow failed traces among those that touch a service anywhere (membership 'any')."""
    res = T.query_traces(V.spans_table(spark, sf_dir), "inventory", _S0, _S1, limit=40, min_duration_ms=80,
                         errors_only=True, membership="any")
    return res["traces"].select("trace_id", "start_us", "duration_us", "spans", "errors", "root_service", "self_us_by_service")
