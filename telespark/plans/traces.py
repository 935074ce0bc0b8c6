"""Q-2 query_traces and Q-3 trace_tree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT_TRACES, MAX_TRACES, SERVICES
from ..operators import spans as S
from ..operators.joins import join_single_rows
from ..operators.prefix import SPLIT_ROWS, sum_before
from ..operators.quantiles import exact_percentiles
from ..session import discard, materialize, stored, tasks_for


def query_traces(spans: DataFrame, service: str, start_us: int, end_us: int,
                 limit: int = DEFAULT_TRACES, min_duration_ms=None, errors_only: bool = False,
                 membership: str = "root", span_cap: int | None = None) -> dict:
    """Sampled traces started by `service` in [start, end), folded.

    Returns DataFrames: `summary` (sampled, returned, p50/p95/max duration ms),
    `self_time` (service, total_us, pct, largest first) and `traces` (at most `limit`,
    slowest first, with the root's operation and route where the spans carry them).
    `sampled` counts the sample before the duration / error filters. `limit` is from 1 to
    MAX_TRACES; others are refused. `span_cap`
    (off by default) folds only the earliest spans of each trace.
    """
    if service not in SERVICES:
        raise ValueError(f"unknown service {service!r}; known: {list(SERVICES)}")
    if not 1 <= int(limit) <= MAX_TRACES:
        raise ValueError(f"limit must be from 1 to {MAX_TRACES}, got {limit!r}")
    picked, sampled = S.sampled_spans(spans, start_us, end_us, limit, service, membership)
    if span_cap:
        # fold only the earliest `span_cap` spans of each trace (store availability cap)
        sampled = S.cap_spans(sampled, span_cap).drop("truncated")
    partials = materialize(S.trace_service_partials(S.self_time(sampled)))
    sample = S.fold_partials(partials).join(picked, "trace_id")
    kept = S.filter_traces(sample, min_duration_ms, errors_only)
    per = (partials.join(kept.select("trace_id"), "trace_id", "left_semi")
           .groupBy("service").agg(F.sum("s").cast("bigint").alias("total_us")))
    total = F.sum("total_us").over(Window.partitionBy())     # over <= #services rows
    self_tbl = per.withColumn("pct", F.when(total > 0, 100.0 * F.col("total_us") / total)
                              .otherwise(F.lit(0.0))).orderBy(F.col("total_us").desc(), "service")
    ms = kept.select((F.col("duration_us") / 1000.0).alias("duration_ms"))
    pct = exact_percentiles(ms, [], "duration_ms", {"p50_ms": 0.5, "p95_ms": 0.95}, passes=1)
    counts = join_single_rows(sample.agg(F.count(F.lit(1)).alias("sampled")),
                              kept.agg(F.count(F.lit(1)).alias("returned"),
                                       F.max(F.col("duration_us") / 1000.0).alias("max_ms")))
    # percentiles of an empty sample produce no row: keep the counts row anyway
    summary = (counts.withColumn("_one", F.lit(1))
               .join(pct.withColumn("_one", F.lit(1)), "_one", "left").drop("_one"))
    traces = S.top_traces(kept, limit)
    return {"summary": summary, "self_time": self_tbl, "traces": traces}


def trace_tree(spans: DataFrame, trace_ids: DataFrame | None = None) -> DataFrame:
    """Preorder rows for many traces at once, of any depth.

    trace_id, span_id, depth, path, offset_us, duration_us, self_us, service, status
    `path` is an array of (start_us, span_id) from the root down; it sorts in preorder.
    Spans unreachable from a root (cycles) are left out; a trace without any parentless
    span is walked from its earliest span. Span ids are unique in a trace
    (`spans.distinct_spans`).

    Pointer doubling on four narrow columns: each round appends the path of the ancestor a
    span points at and takes over its pointer, so the distance doubles and a tree of depth d
    takes log2(d) rounds. A round that leads no further span to a root leaves only cycles.
    """
    spans = _of_traces(spans, trace_ids)
    with tasks_for(spans.sparkSession, spans.count()):
        tables = [stored(_linked(spans).select(
            "trace_id", "span_id", "offset_us", "up", F.array(F.struct("start_us", "span_id")).alias("path")))]
        left, before = tables[0].where("up IS NOT NULL").count(), None
        while left and left != before:
            # spans that reached a root stay where they were stored; only the others go on
            *earlier, last = tables
            nodes = reduce(DataFrame.unionByName, [t.where("up IS NULL") for t in earlier], last)
            above = nodes.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("_next"),
                                 F.col("path").alias("_above"))
            tables.append(stored(last.where("up IS NOT NULL").join(above, ["trace_id", "up"], "left").select(
                "trace_id", "span_id", "offset_us", F.col("_next").alias("up"),
                F.when(F.col("_above").isNull(), F.col("path"))
                .otherwise(F.concat("_above", "path")).alias("path"))))
            left, before = tables[-1].where("up IS NOT NULL").count(), left
    walked = reduce(DataFrame.unionByName, [t.where("up IS NULL") for t in tables])
    return _with_details(spans, walked.drop("up").withColumn("depth", F.size("path") - 1), "path")


def _of_traces(spans: DataFrame, trace_ids: DataFrame | None) -> DataFrame:
    if trace_ids is None:
        return spans
    return spans.join(trace_ids.select("trace_id").distinct(), "trace_id", "left_semi")


def _linked(spans: DataFrame) -> DataFrame:
    """trace_id, span_id, start_us, offset_us, up: every span with the span above it, null
    for those a walk starts from (parentless spans; the earliest span where none is)."""
    narrow = S.resolve_parents(spans.select("trace_id", "span_id", "parent_span_id", "start_us"))
    # origin (earliest root, else earliest span), whether a parentless span exists, and the
    # earliest span as the fallback start point
    key = F.struct(F.col("parent_id").isNotNull(), F.col("start_us"))
    per = narrow.groupBy("trace_id").agg(
        F.min_by("start_us", key).alias("origin_us"),
        F.max(F.col("parent_id").isNull()).alias("_has_root"),
        F.min_by("span_id", F.struct("start_us", "span_id")).alias("_earliest"))
    starts = ~F.col("_has_root") & (F.col("span_id") == F.col("_earliest"))
    return narrow.join(per, "trace_id").select(
        "trace_id", "span_id", "start_us", (F.col("start_us") - F.col("origin_us")).alias("offset_us"),
        F.when(~starts, F.col("parent_id")).alias("up"))


def _with_details(spans: DataFrame, walked: DataFrame, order: str) -> DataFrame:
    cols = ["duration_us", "self_us", "service", "status"]
    cols += [c for c in ("operation", "tags") if c in spans.columns]      # carried for rendering
    return (S.self_time(spans, resolve=False).select("trace_id", "span_id", *cols)
            .join(walked, ["trace_id", "span_id"])
            .select("trace_id", "span_id", "offset_us", *cols, "depth", order))


def _subtrees(nodes: DataFrame) -> DataFrame:
    """trace_id, span_id, size (spans in its subtree), depth of the spans that reach a root.

    `nodes` has trace_id, span_id, up. Each round a span adds the sizes of the spans whose
    pointer is at it, then takes over the pointer of the span above: after k rounds `size`
    counts the descendants less than 2^k below, `depth` the steps to the pointer. A round
    that leads no further span to a root leaves only cycles and what hangs from them.
    """
    key, up = ["trace_id", "span_id"], nodes.schema["up"].dataType
    nodes = stored(nodes.select(*key, "up", F.lit(1).cast("bigint").alias("size"),
                                F.when(F.col("up").isNull(), 0).otherwise(1).alias("depth")))
    left, before = nodes.where("up IS NOT NULL").count(), None
    while left and left != before:
        # a span's own row and the sizes sent to it meet in one aggregate
        sent = nodes.where("up IS NOT NULL").select("trace_id", F.col("up").alias("span_id"), F.lit(None).cast(up).alias("up"),
                                                    "size", F.lit(0).alias("depth"))
        grown = nodes.unionByName(sent).groupBy(*key).agg(
            F.max("up").alias("up"), F.sum("size").alias("size"), F.max("depth").alias("depth"))
        above = nodes.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("_next"),
                             F.col("depth").alias("_steps"))
        done, nodes = nodes, stored(grown.join(above, ["trace_id", "up"], "left").select(
            *key, F.col("_next").alias("up"), "size",
            (F.col("depth") + F.coalesce("_steps", F.lit(0))).alias("depth")))
        discard(done)
        left, before = nodes.where("up IS NOT NULL").count(), left
    return nodes.where("up IS NULL").drop("up")


def trace_preorder(spans: DataFrame, trace_ids: DataFrame | None = None,
                   split_siblings: int = SPLIT_ROWS) -> DataFrame:
    """`trace_tree` with a number in place of the path: `position` is the place of a span in
    the preorder of its trace (from 0, siblings by start and id, gapless over the spans
    that are reached).

    A row keeps its width at any depth, so memory is linear in the spans. In a preorder a
    span comes after its parent and the whole subtrees of its earlier siblings: subtree
    sizes come first, then the steps are added up along the way to the root. Both take
    log2(depth) rounds of pointer doubling, each a few small jobs, so `trace_tree` is faster
    on traces that are not wide or deep; very deep chains are still slow.
    """
    key = ["trace_id", "span_id"]
    spans = _of_traces(spans, trace_ids)
    with tasks_for(spans.sparkSession, spans.count()):
        linked = stored(_linked(spans))
        sizes = _subtrees(linked)
        placed = sum_before(linked.join(sizes, key), ["trace_id", "up"], ["start_us", "span_id"], "size", "_earlier",
                            split_siblings)
        tables = [stored(placed.select(
            *key, "up", "offset_us", "depth",
            (F.col("_earlier") + F.when(F.col("up").isNull(), 0).otherwise(1)).alias("position")))]
        # every span left is a descendant of a root, so the pointers run out
        while tables[-1].where("up IS NOT NULL").limit(1).count():
            *earlier, last = tables
            nodes = reduce(DataFrame.unionByName, [t.where("up IS NULL") for t in earlier], last)
            above = nodes.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("_next"),
                                 F.col("position").alias("_above"))
            tables.append(stored(last.where("up IS NOT NULL").join(above, ["trace_id", "up"], "left").select(
                *key, F.col("_next").alias("up"), "offset_us", "depth",
                (F.col("position") + F.coalesce("_above", F.lit(0))).alias("position"))))
    walked = reduce(DataFrame.unionByName, [t.where("up IS NULL") for t in tables])
    return _with_details(spans, walked.drop("up"), "position")


DETAIL_TAGS = ("db.statement", "exception.type", "exception.message", "error")


def render_tree_lines(tree: DataFrame) -> DataFrame:
    """Adds `line`: '<indent>service[/operation] +Nms dur=..ms self=..ms [status=..]
    [tag=value ...]' with two spaces per level; detail tags (when a `tags` map is
    present) are cut to 120 characters and shown only when non-empty."""
    name = F.col("service")
    if "operation" in tree.columns:
        name = F.concat(name, F.when(F.col("operation").isNotNull(),
                                     F.concat(F.lit("/"), F.col("operation"))).otherwise(F.lit("")))
    parts = [F.concat(F.repeat(F.lit("  "), F.col("depth")), name),
             F.concat(F.lit("+"), F.format_string("%.0f", F.col("offset_us") / 1000.0), F.lit("ms")),
             F.concat(F.lit("dur="), F.format_string("%.1f", F.col("duration_us") / 1000.0), F.lit("ms")),
             F.concat(F.lit("self="), F.format_string("%.1f", F.col("self_us") / 1000.0), F.lit("ms")),
             F.when(F.col("status").isNotNull(), F.concat(F.lit("status="), F.col("status").cast("string")))]
    if "tags" in tree.columns:
        for key in DETAIL_TAGS:
            v = F.col("tags")[key]
            shown = v.isNotNull() & (v != "") & ((F.lit(key) != "error") | ~F.lower(v).isin("false", "0"))
            parts.append(F.when(shown, F.concat(F.lit(key + "="), F.left(v, F.lit(120)))))
    return tree.withColumn("line", F.concat_ws(" ", *parts))
