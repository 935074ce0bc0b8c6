"""Span folding: parents, self-time, per-trace summaries, sampling, trees.

Input spans: trace_id, span_id, parent_span_id, service, start_us, duration_us,
status [, error, operation, route or tags]. Everything is integer microseconds.

Self-time of a span = duration - |union of its direct children's intervals|,
floored at 0; children are not clipped to the parent. The union is a running-max
scan over the children ordered by (start, span_id): a child contributes
max(0, end - max(start, max end of all earlier siblings)). The children of a parent
are one window partition. Parents with more children than a task should hold are
scanned as a prefix scan: their children are dealt to ranges of (parent, start,
span_id) with bounds sampled from the data, each range has its own running max, one
row per (parent, range) carries the max end of the ranges before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import MAX_SPANS_PER_TRACE, SUBWINDOWS
from ..functions.predicates import is_error_span
from ..session import materialize, stored, tasks_for
from .topn import top_n_per_group

SPLIT_CHILDREN = 500_000    # children of one parent that one task scans
SPAN_COLUMNS = ("trace_id", "span_id", "parent_span_id", "service", "start_us", "duration_us", "status",
                "error", "operation", "route", "tags")


def span_columns(df: DataFrame) -> DataFrame:
    """The span columns of a table that may carry derived ones."""
    return df.select(*[c for c in SPAN_COLUMNS if c in df.columns])


def _error_col(df: DataFrame):
    err = F.col("error") if "error" in df.columns else F.lit(None).cast("boolean")
    return is_error_span(err, F.col("status"))


def resolve_parents(spans: DataFrame) -> DataFrame:
    """Adds `parent_id`: parent_span_id when that span exists in the same trace,
    else null (the span is a root)."""
    ids = spans.select("trace_id", F.col("span_id").alias("parent_span_id"),
                       F.col("span_id").alias("parent_id")).distinct()
    return spans.join(ids, ["trace_id", "parent_span_id"], "left")


def trace_roots(spans: DataFrame) -> DataFrame:
    """trace_id, root_service, start_us: the root `fold_traces` picks, from narrow columns."""
    narrow = resolve_parents(spans.select("trace_id", "span_id", "parent_span_id", "service", "start_us"))
    first = F.min_by(F.struct("service", "start_us"),
                     F.struct(F.col("parent_id").isNotNull().alias("p"), "start_us", "span_id"))
    return (narrow.groupBy("trace_id").agg(first.alias("r"))
            .select("trace_id", F.col("r.service").alias("root_service"), F.col("r.start_us").alias("start_us")))


def _added(prev):
    """What a child adds to the union of its earlier siblings, whose ends reach `prev`."""
    length = F.col("end_us") - F.col("start_us")
    return F.when(prev.isNull(), length).otherwise(
        F.greatest(F.lit(0), F.col("end_us") - F.greatest(F.col("start_us"), prev)))


def _scan_ranges(children: DataFrame, n: int, split_children: int) -> DataFrame:
    """(trace_id, parent_id, covered_us) of parents with very many children (`n` in all).

    The stored table keeps the range of every row: bounds are sampled once. A parent
    lies in neighbouring ranges, so there are at most ranges + parents rows to carry.
    """
    key = ["trace_id", "parent_id"]
    most = int(children.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(2, min(n // split_children + 1, most))
    ranged = materialize(children.repartitionByRange(ranges, *key, "start_us", "span_id")
                         .withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy(*key, "_range").orderBy("start_us", "span_id").rowsBetween(
        Window.unboundedPreceding, -1)
    before = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = (ranged.groupBy(*key, "_range").agg(F.max("end_us").alias("_end"))
               .select(*key, "_range", F.max("_end").over(before).alias("_carried")))
    rows = ranged.withColumn("_prev", F.max("end_us").over(inside)).join(carried, key + ["_range"])
    prev = F.greatest("_prev", "_carried")       # greatest skips nulls
    return rows.groupBy(*key).agg(F.sum(_added(prev)).alias("covered_us"))


def child_coverage(spans: DataFrame, split_children: int = SPLIT_CHILDREN) -> DataFrame:
    """(trace_id, span_id, covered_us): union length of each parent's children.

    Grouped on the referenced parent id directly: children of a parent that is not
    in the trace produce a coverage row that later attaches to no span, so no
    parent resolution is needed here.
    """
    key = ["trace_id", "parent_id"]
    children = (spans.where(F.col("parent_span_id").isNotNull())
                .select("trace_id", F.col("parent_span_id").alias("parent_id"), "span_id", "start_us",
                        (F.col("start_us") + F.col("duration_us")).alias("end_us")))

    def scan(rows):
        # the window and the sum share one exchange on (trace, parent)
        prev = F.max("end_us").over(Window.partitionBy(*key).orderBy("start_us", "span_id")
                                    .rowsBetween(Window.unboundedPreceding, -1))
        return rows.withColumn("_prev", prev).groupBy(*key).agg(F.sum(_added(F.col("_prev"))).alias("covered_us"))

    many = None
    if children.count() > split_children:
        big = children.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > split_children)
        many = big.agg(F.sum("_n")).first()[0]
    if many:
        big = materialize(big.select(*key))
        out = scan(children.join(big, key, "left_anti")).unionByName(
            _scan_ranges(children.join(big, key, "left_semi"), many, split_children))
    else:
        out = scan(children)
    return out.withColumnRenamed("parent_id", "span_id")


def self_time(spans: DataFrame, split_children: int = SPLIT_CHILDREN, resolve: bool = True) -> DataFrame:
    """spans + parent_id, covered_us, self_us, is_error.

    Coverage has a single consumer (the join that attaches covered time). For
    `resolve`, references to missing parents are found separately on two narrow
    columns — distinct (trace, parent reference) anti-joined with (trace, span id)
    — usually a handful of rows that AQE broadcasts; their children are roots. No
    join over full span rows is spent on parent resolution.
    `resolve=False` skips the orphan step and leaves `parent_id` out.
    """
    cov = child_coverage(spans, split_children)
    out = spans.join(cov, ["trace_id", "span_id"], "left")
    if resolve:
        refs = (spans.where(F.col("parent_span_id").isNotNull())
                .select("trace_id", F.col("parent_span_id").alias("span_id")).distinct())
        orphans = (refs.join(spans.select("trace_id", "span_id"), ["trace_id", "span_id"], "left_anti")
                   .select("trace_id", F.col("span_id").alias("parent_span_id"))
                   .withColumn("_orphan", F.lit(True)))
        out = out.join(orphans, ["trace_id", "parent_span_id"], "left")
        out = out.withColumn("parent_id", F.when(F.col("_orphan").isNull(), F.col("parent_span_id"))
                             .cast(spans.schema["parent_span_id"].dataType)).drop("_orphan")
    return (out.withColumn("covered_us", F.coalesce("covered_us", F.lit(0)).cast("bigint"))
            .withColumn("self_us", F.greatest(F.lit(0), F.col("duration_us") - F.col("covered_us")))
            .withColumn("is_error", _error_col(out)))


def self_time_by_service(selfs: DataFrame) -> DataFrame:
    """service, self_us, spans, pct (share of all self-time, 0 when the total is 0)."""
    g = selfs.groupBy("service").agg(F.sum("self_us").cast("bigint").alias("self_us"),
                                     F.count(F.lit(1)).alias("spans"))
    total = F.sum("self_us").over(Window.partitionBy())   # over <= #services rows
    return g.withColumn("pct", F.when(total > 0, 100.0 * F.col("self_us") / total).otherwise(F.lit(0.0)))


def trace_service_partials(selfs: DataFrame) -> DataFrame:
    """Per (trace, service): the service's root candidate, self time, span and error
    counts — the first stage of `fold_traces`, reusable by per-service totals."""
    root_key = F.struct(F.col("parent_id").isNotNull().alias("_has_parent"),
                        F.col("start_us").alias("_s"), F.col("span_id").alias("_i"))
    named = [F.col(c) for c in ("operation", "route") if c in selfs.columns]
    if "tags" in selfs.columns and "route" not in selfs.columns:
        named.append(F.col("tags")["http.route"].alias("route"))
    root = F.struct(root_key.alias("k"), F.struct(
        "span_id", "service", "start_us", "duration_us", "status", *named).alias("v"))
    return selfs.groupBy("trace_id", "service").agg(
        F.min(root).alias("_root"), F.sum("self_us").alias("s"),
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_error")).alias("e"))


def fold_partials(per_svc: DataFrame) -> DataFrame:
    """Second stage of `fold_traces`: one row per trace (<= #services inputs each)."""
    named = [c for c in ("operation", "route") if c in per_svc.schema["_root"].dataType["v"].dataType.names]
    per_trace = per_svc.groupBy("trace_id").agg(
        F.min("_root").alias("_root"), F.sum("n").alias("spans"), F.sum("e").alias("errors"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("service", "s"))),
                                 lambda x: F.concat(x["service"], F.lit("="), x["s"].cast("string"))),
                     ";").alias("self_us_by_service"))
    return per_trace.select(
        "trace_id",
        F.col("_root.v.span_id").alias("root_span_id"),
        F.col("_root.v.service").alias("root_service"),
        F.col("_root.v.start_us").alias("start_us"),
        F.col("_root.v.duration_us").alias("duration_us"),
        "spans", "errors",
        F.col("_root.v.status").alias("root_status"),
        "self_us_by_service",
        *[F.col(f"_root.v.{c}").alias(f"root_{c}") for c in named])


def fold_traces(selfs: DataFrame) -> DataFrame:
    """One row per trace: root span, start, duration, span count, errors, root
    status and service, and self-time per service as 'service=us;...' (by name);
    root_operation and root_route where the spans carry an operation and a route (a
    column, or the `http.route` tag).

    One aggregation chain: (trace, service) partials carry the service's root
    candidate, then (trace) picks the root and assembles the per-service list
    (at most one entry per service)."""
    return fold_partials(trace_service_partials(selfs))


def service_self_from_partials(per_svc: DataFrame) -> DataFrame:
    """trace_id, service, self_us, spans from the partials."""
    return per_svc.select("trace_id", "service", F.col("s").cast("bigint").alias("self_us"),
                          F.col("n").alias("spans"))


def trace_service_self(selfs: DataFrame) -> DataFrame:
    """trace_id, service, self_us, spans (long form of the per-trace fold)."""
    return selfs.groupBy("trace_id", "service").agg(
        F.sum("self_us").cast("bigint").alias("self_us"), F.count(F.lit(1)).alias("spans"))


def cap_spans(spans: DataFrame, cap: int = MAX_SPANS_PER_TRACE) -> DataFrame:
    """Earliest `cap` spans per trace by (start_us, span_id), with `truncated`.

    The top cap+1 per trace are taken with the salted two-level ranking (a huge
    trace is spread over many tasks); the (cap+1)-th only marks truncation."""
    ranked = top_n_per_group(spans, ["trace_id"], [F.col("start_us"), F.col("span_id")], cap + 1,
                             rank_col="_rn")
    trunc = F.max(F.col("_rn")).over(Window.partitionBy("trace_id")) > cap   # <= cap+1 rows per trace
    return ranked.withColumn("truncated", trunc).where(F.col("_rn") <= cap).drop("_rn")


def filter_traces(folded: DataFrame, min_duration_ms=None, errors_only: bool = False) -> DataFrame:
    out = folded
    if min_duration_ms is not None:
        out = out.where(F.col("duration_us") >= F.lit(float(min_duration_ms) * 1000.0))
    if errors_only:
        out = out.where(F.col("errors") > 0)
    return out


def sample_traces(folded: DataFrame, start_us: int, end_us: int, limit: int,
                  service: str | None = None, membership: str = "root",
                  members: DataFrame | None = None) -> DataFrame:
    """Stratified sample: the window is cut into 3 half-open slices and the newest
    max(1, limit // 3) traces of each slice are kept (ties by trace_id).

    `membership='root'` keeps traces whose root service is `service`; 'any' keeps
    traces listed in `members` (see `traces_touching`), a semi-join."""
    if end_us <= start_us:
        raise ValueError("the sampling window must have end > start")
    per = max(1, int(limit) // SUBWINDOWS)
    t = folded.where(F.col("start_us") >= start_us).where(F.col("start_us") < end_us)
    if service is not None:
        if membership == "root":
            t = t.where(F.col("root_service") == service)
        elif membership == "any":
            if members is None:
                raise ValueError("membership='any' needs `members` (trace ids with a span of the service)")
            t = t.join(members.select("trace_id"), "trace_id", "left_semi")
        else:
            raise ValueError("membership must be 'root' or 'any'")
    length = end_us - start_us
    sl = F.least(F.lit(SUBWINDOWS - 1), F.floor((F.col("start_us") - F.lit(start_us)) * SUBWINDOWS / F.lit(length)))
    t = t.withColumn("slice", sl.cast("int"))
    # three slices are three hot keys: salted two-level top-N
    return top_n_per_group(t, ["slice"], [F.col("start_us").desc(), F.col("trace_id")], per,
                           rank_col="_rn").drop("_rn")


def sampled_ids(spans: DataFrame, start_us: int, end_us: int, limit: int, service: str | None = None,
                membership: str = "root") -> DataFrame:
    """trace_id, slice of the traces that `sample_traces` picks, found before anything is
    folded: spans that start in the window (a scan filter) name the traces, the roots of
    those follow from narrow columns."""
    inside = (F.col("start_us") >= start_us) & (F.col("start_us") < end_us)
    first = spans.where(inside)
    if service is not None and membership == "root":
        first = first.where(F.col("service") == service)      # the root span is one of these
    within = spans.join(first.select("trace_id"), "trace_id", "left_semi")
    members = traces_touching(within, service) if service is not None and membership == "any" else None
    return sample_traces(trace_roots(within), start_us, end_us, limit, service, membership, members).select(
        "trace_id", "slice")


def sampled_spans(spans: DataFrame, start_us: int, end_us: int, limit: int, service: str | None = None,
                  membership: str = "root") -> tuple[DataFrame, DataFrame]:
    """`sampled_ids` (at most max(3, limit) rows, marked for broadcast) and the spans of those
    traces, both stored: what follows reads the sampled traces only."""
    with tasks_for(spans.sparkSession, spans.count()):
        picked = F.broadcast(stored(sampled_ids(spans, start_us, end_us, limit, service, membership)))
        return picked, stored(spans.join(picked, "trace_id", "left_semi"))


def top_traces(folded: DataFrame, limit: int) -> DataFrame:
    """Slowest `limit` traces, ties broken by trace_id (TakeOrderedAndProject)."""
    return folded.orderBy(F.col("duration_us").desc(), F.col("trace_id")).limit(int(limit))


def span_offsets(selfs: DataFrame) -> DataFrame:
    """offset_us of every span from its trace origin (earliest root, else earliest span).

    The origin is a per-trace aggregate joined back (partial aggregation), not a
    window over the whole trace."""
    key = F.struct(F.col("parent_id").isNotNull(), F.col("start_us"))
    origin = selfs.groupBy("trace_id").agg(F.min_by("start_us", key).alias("origin_us"))
    return (selfs.join(origin, "trace_id")
            .withColumn("offset_us", F.col("start_us") - F.col("origin_us")))


def distinct_spans(spans: DataFrame) -> DataFrame:
    """One row per (trace_id, span_id): the same trace fetched twice (overlapping
    exports or sub-windows) counts once."""
    return spans.dropDuplicates(["trace_id", "span_id"])


def traces_touching(spans: DataFrame, service: str) -> DataFrame:
    """trace_id of every trace with at least one span of `service`."""
    return spans.where(F.col("service") == service).select("trace_id").distinct()
