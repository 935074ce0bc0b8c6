"""Scoring against labelled incidents: Q-5 signal verdicts, Q-6 replay, Q-7 dominance,
Q-8 recovery, Q-9 annotated series, evidence index and payload reduction.

Incidents are a small label table (incident_id, service, fault_type, start_us,
end_us [, confirmed_start_us, confirmed_end_us]); rows are matched to them with
`interval_join` (bucketed equi-join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DOMINANCE_ASSERTED, DOMINANCE_MIN_SHARE
from ..functions.time import scoring_end, scoring_start
from ..operators import spans as S
from ..operators.joins import interval_join

DAY_US = 86400 * 1000000


def evidence_windows(incidents: DataFrame) -> DataFrame:
    """incident_id, win_start_us, win_end_us: the confirmed bounds where a label has them."""
    start = scoring_start() if "confirmed_start_us" in incidents.columns else F.col("start_us")
    end = scoring_end() if "confirmed_end_us" in incidents.columns else F.col("end_us")
    return incidents.select("incident_id", start.alias("win_start_us"), end.alias("win_end_us"))


SCAN_RANGES = 64      # ranges of a scan filter; more windows share one from first to last


def scan_bounds(windows: DataFrame, ts: str = "start_us"):
    """A filter with literal bounds that every row inside a window passes, so that it
    reaches the scan (partitions, row groups): one range per window, or one for all
    where there are more than SCAN_RANGES."""
    some = windows.where("win_start_us <= win_end_us").select("win_start_us", "win_end_us").limit(SCAN_RANGES + 1).collect()
    if len(some) > SCAN_RANGES:
        some = windows.agg(F.min("win_start_us"), F.max("win_end_us")).collect()
    out = F.lit(False)
    for lo, hi in some:
        out = out | F.col(ts).between(lo, hi)
    return out


def traces_in_windows(spans: DataFrame, incidents: DataFrame, root_service: str | None,
                      bucket_us: int = DAY_US) -> DataFrame:
    """incident_id, trace_id, start_us: traces whose root starts inside a window.

    Nothing is folded to find them: the root span itself is a span of the root service
    that starts in a window, which the scan can filter; the roots of the traces named so
    follow from narrow columns, and only ids come back. (A semi-join on plain filtered
    ids, not on their distinct values: for that Spark puts a bloom filter of the ids
    under the exchange of the spans where both sides are large.) Stored, since callers
    join it more than once.
    """
    from ..session import materialize
    windows = evidence_windows(incidents)
    first = spans.where(scan_bounds(windows))
    if root_service is not None:
        first = first.where(F.col("service") == root_service)
    within = spans.join(first.select("trace_id"), "trace_id", "left_semi")
    roots = S.trace_roots(within)
    if root_service is not None:
        roots = roots.where(F.col("root_service") == root_service)
    j = interval_join(roots, windows, "start_us", "win_start_us", "win_end_us", bucket_us)
    return materialize(j.select("incident_id", "trace_id", "start_us"))


def spans_of(spans: DataFrame, traced: DataFrame) -> DataFrame:
    """The spans of the traces in `traced`, each once."""
    return S.span_columns(spans).join(traced.select("trace_id"), "trace_id", "left_semi")


def evidence_index(spans: DataFrame, incidents: DataFrame, root_service: str = "gateway",
                   traced: DataFrame | None = None) -> DataFrame:
    """incident_id, root_service, traces, spans (O-08)."""
    traced = traces_in_windows(spans, incidents, root_service) if traced is None else traced
    sizes = spans_of(spans, traced).groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"))
    return (traced.join(sizes, "trace_id").groupBy("incident_id")
            .agg(F.count(F.lit(1)).alias("traces"), F.sum("n").cast("bigint").alias("spans"))
            .select("incident_id", F.lit(root_service).alias("root_service"), "traces", "spans"))


def verify_dominance(spans: DataFrame, labels: DataFrame, evidence: DataFrame,
                     root_service: str = "gateway", min_share: float = DOMINANCE_MIN_SHARE) -> DataFrame:
    """Per evidence incident: top self-time service and share; latency faults must be
    dominated (>= min_share %) by the faulted service; others are reported ('info');
    evidence without a label is an ORPHAN. Windows are the confirmed bounds where the
    evidence has them. Self-time is only taken of the traces in a window."""
    traced = traces_in_windows(spans, evidence, root_service)
    per_trace = S.trace_service_self(S.self_time(spans_of(spans, traced), resolve=False))
    per = (traced.select("incident_id", "trace_id").join(per_trace, "trace_id")
           .groupBy("incident_id", "service").agg(F.sum("self_us").alias("self_us")))
    # windows below run over <= #services rows per incident
    tot = F.sum("self_us").over(Window.partitionBy("incident_id"))
    shares = per.withColumn("pct", F.when(tot > 0, 100.0 * F.col("self_us") / tot).otherwise(F.lit(0.0)))
    top = (shares.withColumn("_rk", F.row_number().over(
        Window.partitionBy("incident_id").orderBy(F.col("self_us").desc(), F.col("service"))))
        .where(F.col("_rk") == 1)
        .select("incident_id", F.col("service").alias("top_service"), F.col("pct").alias("top_pct")))
    n = traced.groupBy("incident_id").agg(F.count(F.lit(1)).alias("traces"))
    lab = labels.select("incident_id", "fault_type", "service")
    asserted = F.coalesce(F.create_map(*[x for k, v in DOMINANCE_ASSERTED.items()
                                         for x in (F.lit(k), F.lit(v))])[F.col("fault_type")], F.lit(False))
    ev = evidence.select("incident_id").distinct()
    out = (ev.join(lab, "incident_id", "left").join(n, "incident_id", "left")
           .join(top, "incident_id", "left")
           .withColumn("traces", F.coalesce("traces", F.lit(0)))
           .withColumn("asserted", asserted))
    verdict = (F.when(F.col("fault_type").isNull(), "ORPHAN")
               .when(~F.col("asserted"), "info")
               .when((F.col("top_service") == F.col("service")) & (F.col("top_pct") >= min_share), "ok")
               .otherwise("FAIL"))
    return out.withColumn("verdict", verdict)


_WHOLE = {"ignoreNullFields": "false"}


def _raw_span_json(spans: DataFrame):
    """A span as a trace store serves it; the operation is the service's name where the
    spans have none."""
    def text(c):
        return F.col(c).cast("string")
    ref = F.struct(F.lit("CHILD_OF").alias("refType"), text("parent_span_id").alias("spanID"))
    name = F.coalesce("operation", "service") if "operation" in spans.columns else F.col("service")
    return F.to_json(F.struct(
        text("trace_id").alias("traceID"), text("span_id").alias("spanID"), name.alias("operationName"),
        F.col("start_us").alias("startTime"), F.col("duration_us").alias("duration"),
        F.filter(F.array(ref), lambda r: r["spanID"].isNotNull()).alias("references"),
        F.array(F.struct(F.lit("http.response.status_code").alias("key"), F.col("status").alias("value"))).alias("tags")),
        _WHOLE)


def _served_json():
    return F.to_json(F.struct(F.col("trace_id").cast("string").alias("trace_id"), "duration_us", "spans", "errors",
                              F.col("self_us_by_service").alias("self_us")), _WHOLE)


def payload_reduction(spans: DataFrame, incidents: DataFrame, root_service: str = "gateway") -> DataFrame:
    """Bytes of the raw span documents vs the folded summaries, per incident window
    (O-56); tokens estimated at 4 bytes each. Only the traces in a window are folded."""
    traced = traces_in_windows(spans, incidents, root_service).select("incident_id", "trace_id")
    inside = spans_of(spans, traced)
    served = S.fold_traces(S.self_time(inside)).select("trace_id", F.octet_length(_served_json()).alias("s"))
    raw = inside.groupBy("trace_id").agg(F.sum(F.octet_length(_raw_span_json(inside))).alias("b"))
    per = (traced.join(raw, "trace_id").join(served, "trace_id").groupBy("incident_id")
           .agg(F.sum("b").alias("raw_bytes"), F.sum("s").alias("served_bytes")))
    return per.select("incident_id", F.col("raw_bytes").cast("bigint").alias("raw_bytes"),
                      F.col("served_bytes").cast("bigint").alias("served_bytes"),
                      (F.col("raw_bytes") / F.col("served_bytes")).alias("reduction"),
                      F.floor(F.col("raw_bytes") / 4).cast("bigint").alias("raw_tokens"),
                      F.floor(F.col("served_bytes") / 4).cast("bigint").alias("served_tokens"))


# ---------------------------------------------------------------------------
# Q-5 signal verdicts
# ---------------------------------------------------------------------------

from ..config import (RECOVERY_FACTOR, RECOVERY_FLOOR_MS, RECOVERY_PROBES,  # noqa: E402
                      REPLAY_TOLERANCE_POINTS, SETTLE_MARGIN_S, SETTLE_MAX_S)
from ..functions.predicates import is_5xx, label_eq  # noqa: E402
from ..functions.scalars import fault_metric, id_suffix  # noqa: E402
from ..operators import requests as R  # noqa: E402
from ..operators import series as SR  # noqa: E402
from ..operators.joins import join_single_rows, nearest_rows  # noqa: E402
from ..operators.quantiles import bounded_median, exact_percentiles  # noqa: E402

US = 1_000_000


def settle_us(start: str = "start_us", end: str = "end_us"):
    """min(45 s, max(0, duration - 30 s)) in µs."""
    return F.least(F.lit(int(SETTLE_MAX_S * US)),
                   F.greatest(F.lit(0), F.col(end) - F.col(start) - F.lit(int(SETTLE_MARGIN_S * US))))


def baseline_windows(runs: DataFrame, incidents: DataFrame, edge_s: float = 15.0) -> DataFrame:
    """One quiet window per run (not per incident): from run start + 15 s to the
    first incident's start - 15 s. runs: run_id, started_us; incidents carry run_id."""
    first = incidents.groupBy("run_id").agg(F.min("start_us").alias("_first"))
    e = int(edge_s * US)
    return (runs.join(first, "run_id", "left")
            .select("run_id", (F.col("started_us") + e).alias("baseline_start_us"),
                    (F.col("_first") - e).alias("baseline_end_us")))


def signal_points(requests: DataFrame, start_us: int, end_us: int, step_us: int, range_us: int,
                  gauges: DataFrame | None = None, gauge_service: str = "inventory",
                  lookback_us: int = 300 * US) -> DataFrame:
    """Long table metric, service, step_us, value for the checked metrics:
    p95 (exact, ms), error_ratio (%), request_rate (/s), application routes only;
    with `gauges` also pool_<state> = `sum by (state)` of the latest sample per step."""
    st = SR.assign_steps(R.application(requests), start_us, end_us, step_us, range_us)
    p95 = exact_percentiles(st, ["service", "step_us"], "duration_ms", {"value": 0.95})
    red = R.red_series(requests, start_us, end_us, step_us, range_us)
    long = red.select("service", "step_us", F.explode(F.array(
        F.struct(F.lit("error_ratio").alias("metric"), F.col("error_ratio").alias("value")),
        F.struct(F.lit("request_rate").alias("metric"), F.col("request_rate").alias("value")))).alias("m"))
    long = long.select(F.col("m.metric").alias("metric"), "service", "step_us", F.col("m.value").alias("value"))
    out = long.unionByName(p95.select(F.lit("p95").alias("metric"), "service", "step_us", "value"))
    if gauges is not None:
        from ..operators.counters import gauge_series
        g = gauge_series(gauges, ["pool_name", "state"], start_us, end_us, step_us, lookback_us)
        g = g.groupBy("state", "step_us").agg(F.sum("value").alias("value"))
        out = out.unionByName(g.select(F.concat(F.lit("pool_"), F.col("state")).alias("metric"),
                                       F.lit(gauge_service).alias("service"), "step_us", "value"))
    return out


def verify_signals(points: DataFrame, incidents: DataFrame, checks: DataFrame,
                   baseline_start_us: int | None = None, baseline_end_us: int | None = None,
                   baselines: DataFrame | None = None) -> DataFrame:
    """Per incident x check: baseline median vs the extreme during the incident.

    rise: YES when max - before >= min_delta, else NO; fall: before - min; flat:
    the worst excursion |v - before| <= tolerance -> FLAT, else MOVED; no baseline
    or no during sample -> NO DATA. `during` skips the settle time at the start.
    The baseline is one aggregate per (metric, service) over the quiet window: one window
    for all, or with `baselines` (see `baseline_windows`) that of each incident's run.
    """
    from ..session import materialize
    points = materialize(points)      # a small aggregate read by the baseline and the during side
    run = [] if baselines is None else ["run_id"]
    key = [*run, "metric", "service"]
    if baselines is None:
        quiet = points.where(F.col("step_us").between(baseline_start_us, baseline_end_us))
    else:
        quiet = interval_join(points, baselines.select("run_id", "baseline_start_us", "baseline_end_us"), "step_us",
                              "baseline_start_us", "baseline_end_us")
    base = quiet.groupBy(*key).agg(bounded_median("value").alias("before"))
    inc = incidents.select("incident_id", F.col("service").alias("inc_service"), "fault_type",
                           "start_us", "end_us", *run)
    cw = (checks.join(inc, "incident_id")
          .withColumn("from_us", F.col("start_us") + settle_us()).withColumnRenamed("end_us", "to_us")
          .drop("start_us"))
    win = cw.select("incident_id", "name", "metric", "service", "from_us", "to_us", *run)
    during = interval_join(points.where(F.col("value").isNotNull()), win, "step_us", "from_us", "to_us",
                           DAY_US, on=["metric", "service"])
    during = during.join(base, key, "left")
    dev = F.when(F.col("before").isNotNull(), F.abs(F.col("value") - F.col("before"))).otherwise(F.col("value"))
    agg = during.groupBy("incident_id", "name").agg(
        F.count(F.lit(1)).alias("samples"), F.max("value").alias("_max"), F.min("value").alias("_min"),
        F.max_by("value", F.struct(dev, -F.col("step_us"))).alias("_worst"))
    out = (cw.join(base, key, "left").join(agg, ["incident_id", "name"], "left")
           .withColumn("samples", F.coalesce("samples", F.lit(0))))
    during_v = (F.when(F.col("expect") == "rise", F.col("_max"))
                .when(F.col("expect") == "fall", F.col("_min")).otherwise(F.col("_worst")))
    out = out.withColumn("during", during_v)
    verdict = (F.when(F.col("before").isNull() | F.col("during").isNull(), "NO DATA")
               .when(F.col("expect") == "rise",
                     F.when(F.col("during") - F.col("before") >= F.col("min_delta"), "YES").otherwise("NO"))
               .when(F.col("expect") == "fall",
                     F.when(F.col("before") - F.col("during") >= F.col("min_delta"), "YES").otherwise("NO"))
               .otherwise(F.when(F.abs(F.col("during") - F.col("before")) <= F.col("tolerance"), "FLAT")
                          .otherwise("MOVED")))
    return out.select(id_suffix("incident_id").alias("incident"), F.col("inc_service").alias("service"),
                      F.col("fault_type").alias("fault"), F.col("name").alias("metric"), "expect",
                      "before", "during", "samples", "unit", verdict.alias("verdict"))


def format_signals(rows: DataFrame) -> DataFrame:
    """Markdown table lines (3 decimals, 'n/a' for null); a small report."""
    from ..functions.scalars import format_value
    return rows.select(F.concat_ws(" | ", F.lit("|"), "incident", "service", "fault", "metric", "expect",
                                   format_value("before"), format_value("during"), "unit",
                                   F.col("samples").cast("string"),
                                   F.concat(F.lit("**"), F.col("verdict"), F.lit("**")), F.lit("|"))
                       .alias("line"))


# ---------------------------------------------------------------------------
# O-54 / O-55 observed counts, Q-6 replay
# ---------------------------------------------------------------------------

def incident_observed(requests: DataFrame, incidents: DataFrame) -> DataFrame:
    """Per incident, on its service's application routes inside [start, end]:
    requests_seen, requests_delayed (every request of a latency fault),
    requests_failed (5xx) and failed_pct = 100*failed/seen (null when none seen)."""
    win = incidents.select("incident_id", "service", "fault_type",
                           F.col("start_us").alias("w_start"), F.col("end_us").alias("w_end"))
    j = interval_join(R.application(requests), win, "ts_us", "w_start", "w_end", DAY_US, on=["service"])
    g = j.groupBy("incident_id").agg(
        F.count(F.lit(1)).alias("requests_seen"),
        F.count_if(F.col("fault_type") == "latency").alias("requests_delayed"),
        F.count_if(is_5xx("status")).alias("requests_failed"))
    g = incidents.select("incident_id").join(g, "incident_id", "left").fillna(
        0, ["requests_seen", "requests_delayed", "requests_failed"])
    return g.withColumn("failed_pct", F.when(F.col("requests_seen") > 0,
                                             100.0 * F.col("requests_failed") / F.col("requests_seen")))


def replay(requests: DataFrame, labels: DataFrame, as_of_us: int, retention_hours: float,
           gauges: DataFrame | None = None, tolerance: float = REPLAY_TOLERANCE_POINTS) -> DataFrame:
    """Ground-truth replay: query each labelled window (confirmed bounds preferred)
    for the metric its fault should move, the way the metric query would.

    EXPIRED: window ends before the retention horizon; a start before it is
    clamped. EMPTY: no sample of the selected series in the window. For
    error_ratio the measured max over the dense points (each over the rate
    window) is compared to the labelled failed % (+- tolerance): MATCH / MISMATCH;
    other metrics are 'reported'. All labels are scored in one plan.
    """
    horizon = as_of_us - int(retention_hours * 3600 * US)
    cs = "confirmed_start_us" if "confirmed_start_us" in labels.columns else "start_us"
    ce = "confirmed_end_us" if "confirmed_end_us" in labels.columns else "end_us"
    lab = (labels.withColumn("metric", fault_metric("fault_type"))
           .withColumn("w_start", F.coalesce(F.col(cs), F.col("start_us")))
           .withColumn("w_end", F.coalesce(F.col(ce), F.col("end_us")))
           .withColumn("expired", F.col("w_end") < F.lit(horizon))
           .withColumn("clamped", ~F.col("expired") & (F.col("w_start") < F.lit(horizon)))
           .withColumn("w_start", F.greatest(F.col("w_start"), F.lit(horizon))))
    dur_s = (F.col("w_end") - F.col("w_start")) / US
    rate_s = F.greatest(F.lit(2.0), F.bround(F.greatest(F.lit(30.0), F.least(F.lit(300.0), dur_s / 4.0)) / 15.0)) * 15
    fetch_s = F.greatest(F.lit(15), F.floor(dur_s / 600 / 15 + 1).cast("bigint") * 15)
    lab = (lab.withColumn("rate_window_s", rate_s.cast("bigint"))
           .withColumn("fetch_step_s", fetch_s.cast("bigint")))
    # labels are few but may be derived from a large computation: materialize once
    # so the join size checks below do not re-run it
    from ..session import materialize
    lab = materialize(lab)
    live = lab.where(~F.col("expired"))
    # dense error-ratio points per label, all labels at once
    win = live.where(F.col("metric") == "error_ratio").select(
        "incident_id", "service", "w_start", "w_end", "rate_window_s", "fetch_step_s",
        (F.col("w_start") - F.col("rate_window_s") * US + 1).alias("_from"))
    rows = interval_join(R.application(requests), win, "ts_us", "_from", "w_end", DAY_US, on=["service"])
    st = SR.assign_steps(rows, F.col("w_start"), F.col("w_end"), F.col("fetch_step_s") * US,
                         F.col("rate_window_s") * US)
    per_step = st.groupBy("incident_id", "step_us").agg(F.count(F.lit(1)).alias("n"),
                                                         F.count_if(is_5xx("status")).alias("e"))
    ratio = per_step.groupBy("incident_id").agg(
        F.max(100.0 * F.col("e") / F.col("n")).alias("measured_max"),
        F.sum("e").alias("_errors"))
    # emptiness of the selected series inside the window (non-error metrics)
    sel_win = live.select("incident_id", "service", "metric", "w_start", "w_end")
    seen = interval_join(R.application(requests).select("service", "ts_us"), sel_win, "ts_us",
                         "w_start", "w_end", DAY_US, on=["service"]).groupBy("incident_id").agg(
        F.count(F.lit(1)).alias("_rows"))
    out = lab.join(ratio, "incident_id", "left").join(seen, "incident_id", "left")
    if gauges is not None:
        gw = live.where(F.col("metric") == "db_pool").select("incident_id", "w_start", "w_end")
        g = interval_join(label_eq(gauges, pool_name="inventory-pool").select("ts_us"), gw, "ts_us", "w_start", "w_end", DAY_US)
        out = out.join(g.groupBy("incident_id").agg(F.count(F.lit(1)).alias("_gauge_rows")), "incident_id", "left")
    else:
        out = out.withColumn("_gauge_rows", F.lit(None).cast("bigint"))
    has_data = (F.when(F.col("metric") == "error_ratio", F.coalesce(F.col("_errors"), F.lit(0)) > 0)
                .when(F.col("metric") == "db_pool", F.coalesce(F.col("_gauge_rows"), F.lit(0)) > 0)
                .otherwise(F.coalesce(F.col("_rows"), F.lit(0)) > 0))
    status = F.when(F.col("expired"), "EXPIRED").when(~has_data, "EMPTY").otherwise("ok")
    labelled = (F.when(F.col("requests_seen") > 0, 100.0 * F.col("requests_failed") / F.col("requests_seen"))
                if "requests_seen" in labels.columns else F.lit(None).cast("double"))
    out = out.withColumn("status", status).withColumn("labelled_pct", labelled)
    verdict = (F.when(F.col("status") != "ok", F.col("status"))
               .when((F.col("metric") == "error_ratio") & F.col("labelled_pct").isNotNull(),
                     F.when(F.abs(F.col("measured_max") - F.col("labelled_pct")) <= tolerance, "MATCH")
                     .otherwise("MISMATCH"))
               .otherwise("reported"))
    return out.select("incident_id", "fault_type", "service", "metric", "status", "clamped",
                      F.col("w_start").alias("window_start_us"), F.col("w_end").alias("window_end_us"),
                      "rate_window_s", "fetch_step_s", "labelled_pct",
                      F.when(F.col("status") == "ok", F.col("measured_max")).alias("measured_max"),
                      verdict.alias("verdict"),
                      F.when(F.col("expired"), F.lit(horizon)).alias("oldest_available_us"))


# ---------------------------------------------------------------------------
# Q-8 recovery
# ---------------------------------------------------------------------------

def verify_recovery(requests: DataFrame, incidents: DataFrame, baseline_start_us: int,
                    baseline_end_us: int, probes: int = RECOVERY_PROBES,
                    front_door: str = "gateway") -> DataFrame:
    """After each incident: the next `probes` front-door requests must all succeed
    and their nearest-index p95 must be <= max(400 ms, 4 x baseline p95), and no
    other incident may still be active at the end ("inert"). With fewer requests
    after it nothing is shown yet: state 'too few probes' instead of 'recovered' or
    'not recovered'."""
    door = R.application(requests).where(F.col("service") == front_door)
    base = exact_percentiles(door.where(F.col("ts_us").between(baseline_start_us, baseline_end_us)),
                             [], "duration_ms", {"baseline_p95_ms": 0.95}, "nearest")
    anchors = incidents.select("incident_id", F.col("end_us").alias("at_us"))
    got = nearest_rows(door, anchors, probes, "after")
    p95 = exact_percentiles(got, ["incident_id"], "duration_ms", {"probe_p95_ms": 0.95}, "nearest", passes=1)
    agg = got.groupBy("incident_id", "at_us").agg(
        F.count(F.lit(1)).alias("probes"),
        F.count_if(~F.col("status").eqNullSafe(F.lit(200))).alias("probe_failures"),
        ((F.max("ts_us") - F.col("at_us")) / US).alias("recovery_s"))
    # still active: another incident covering this one's end
    ends = incidents.select(F.col("incident_id").alias("_self"), F.col("end_us").alias("_end"))
    wins = incidents.select(F.col("incident_id").alias("_other"), F.col("start_us").alias("_s"),
                            F.col("end_us").alias("_e"))
    busy = (interval_join(ends, wins, "_end", "_s", "_e", DAY_US).where(F.col("_self") != F.col("_other"))
            .select(F.col("_self").alias("incident_id")).distinct().withColumn("_busy", F.lit(True)))
    out = (incidents.select("incident_id").join(agg, "incident_id", "left").join(p95, "incident_id", "left")
           .join(busy, "incident_id", "left"))
    out = join_single_rows(out, base)
    ceiling = F.greatest(F.lit(RECOVERY_FLOOR_MS), F.lit(RECOVERY_FACTOR) * F.col("baseline_p95_ms"))
    inert = ~F.coalesce(F.col("_busy"), F.lit(False))
    enough = F.coalesce("probes", F.lit(0)) >= probes
    recovered = (inert & enough & (F.coalesce("probe_failures", F.lit(0)) == 0)
                 & F.coalesce(F.col("probe_p95_ms") <= ceiling, F.lit(False)))
    state = F.when(~enough, "too few probes").when(recovered, "recovered").otherwise("not recovered")
    return out.select("incident_id", F.coalesce("probes", F.lit(0)).alias("probes"),
                      F.coalesce("probe_failures", F.lit(0)).alias("probe_failures"),
                      "probe_p95_ms", ceiling.alias("probe_ceiling_ms"), inert.alias("inert"),
                      recovered.alias("recovered"), state.alias("state"), "recovery_s")


# ---------------------------------------------------------------------------
# O-10 annotations, Q-9 annotated series
# ---------------------------------------------------------------------------

def annotations(incidents: DataFrame) -> DataFrame:
    """Region annotations: time_ms, time_end_ms, tags ['chaos', service, fault], text."""
    params = F.to_json("params") if "params" in incidents.columns else F.lit("{}")
    return incidents.select(
        "incident_id",
        F.floor(F.col("start_us") / 1000).cast("bigint").alias("time_ms"),
        F.floor(F.col("end_us") / 1000).cast("bigint").alias("time_end_ms"),
        F.array(F.lit("chaos"), F.col("service"), F.col("fault_type")).alias("tags"),
        F.concat(F.col("incident_id"), F.lit(" - "), F.col("fault_type"), F.lit(" on "),
                 F.col("service"), F.lit(" "), params).alias("text"))


def annotate(points: DataFrame, incidents: DataFrame, required_tags=("chaos",),
             ts: str = "step_us") -> DataFrame:
    """Each point with the ids of the incidents covering it whose tags include all
    `required_tags` ('id1,id2', '' when none). The ids are found once per instant, so
    equal points stay separate rows and columns of any type are carried."""
    ann = annotations(incidents)
    req = F.array(*[F.lit(t) for t in required_tags])
    ann = ann.where(F.size(F.array_except(req, F.col("tags"))) == 0).select(
        F.col("incident_id").alias("_inc"), (F.col("time_ms") * 1000).alias("_a_start"),
        (F.col("time_end_ms") * 1000).alias("_a_end"))
    j = interval_join(points.select(ts).distinct(), ann, ts, "_a_start", "_a_end", DAY_US)
    ids = j.groupBy(ts).agg(F.array_join(F.array_sort(F.collect_list("_inc")), ",").alias("incidents"))
    return points.join(ids, ts, "left").select(*points.columns, F.coalesce("incidents", F.lit("")).alias("incidents"))
