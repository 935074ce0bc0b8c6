"""Q-10 dashboard panels as tables: one row per (panel, series) with the panel
legend values last (non-null), mean and max over the window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import app_routes, is_5xx, label_eq
from ..operators import counters as C
from ..operators import panes as P
from ..operators import series as SR
from ..session import materialize
from ..sources.views import BUCKET_BOUNDS_MS
from ..streaming.red import rollup_quantiles

US = 1_000_000


def _le_name(bound: float) -> str:
    return f"le_{str(bound).replace('.', '_')}"


def request_ranges(requests: DataFrame, start_us: int, end_us: int, step_us: int, ranges: dict) -> DataFrame:
    """range_name, service, step_us with all counts the request panels need, from one scan:
    app requests `requests`, their cumulative bucket counts `le_*`, and the 5xx of every
    route but the control plane (`errors`)."""
    app = app_routes("route")
    aggs = {"requests": F.count_if(app), "errors": F.count_if(is_5xx("status"))}
    aggs.update({_le_name(b): F.count_if(app & (F.col("duration_ms") <= F.lit(float(b)))) for b in BUCKET_BOUNDS_MS})
    seen = requests.where(~F.coalesce(F.col("route"), F.lit("")).like("/chaos%"))
    return P.ranged_counts(seen, ["service"], aggs, start_us, end_us, step_us, ranges)


def panel_points(requests: DataFrame, start_us: int, end_us: int, step_us: int,
                 pool_gauge: DataFrame | None = None, pipeline: DataFrame | None = None,
                 heap: DataFrame | None = None, pending: DataFrame | None = None,
                 rate_range_us: int | None = None, quantile_range_us: int | None = None) -> DataFrame:
    """Long table panel, series, step_us, value.

    Rates cover (t - rate_range, t] and the p95 (t - quantile_range, t]; both ranges are
    the step unless given (a dashboard has 1 m and 5 m whatever its step). The request
    panels share one pane aggregation, whose result (services x steps x ranges) is stored
    once and read by all three. `pending` (pool_name, ts_us, value) is a series of the pool
    panel. `heap` (ts_us, value, `area`, `service`) is summed by service over area 'heap';
    without a service column by area.
    """
    rate_us, quantile_us = int(rate_range_us or step_us), int(quantile_range_us or step_us)
    spark = requests.sparkSession
    ranges = {"rate": rate_us} if rate_us == quantile_us else {"rate": rate_us, "quantile": quantile_us}
    counts = materialize(request_ranges(requests, start_us, end_us, step_us, ranges))
    rates = counts.where(F.col("range_name") == "rate")
    app = rates.where(F.col("requests") > 0)
    grid = SR.step_grid(spark, app.select("service").distinct(), start_us, end_us, step_us)
    rate = SR.zero_fill(app.select("service", "step_us", "requests"), grid, ["service", "step_us"],
                        ["requests"]).select(
        F.lit("request_rate").alias("panel"), F.col("service").alias("series"), "step_us",
        (F.col("requests") / (rate_us / US)).alias("value"))
    errs = rates.where(F.col("errors") > 0).select(
        F.lit("errors_5xx").alias("panel"), F.col("service").alias("series"), "step_us",
        (F.col("errors") / (rate_us / US)).alias("value"))
    hist = counts.where((F.col("range_name") == list(ranges)[-1]) & (F.col("requests") > 0))
    p95 = rollup_quantiles(hist, ["service", "step_us"], {"value": 0.95}).select(
        F.lit("p95_ms").alias("panel"), F.col("service").alias("series"), "step_us", "value")
    out = rate.unionByName(p95).unionByName(errs)
    if pool_gauge is not None:
        g = C.gauge_series(label_eq(pool_gauge, pool_name="inventory-pool"), ["pool_name", "state"],
                           start_us, end_us, step_us)
        out = out.unionByName(_gauge_panel("pool", g, F.col("state")))
    if pending is not None:
        g = C.gauge_series(label_eq(pending, pool_name="inventory-pool"), ["pool_name"], start_us, end_us, step_us)
        out = out.unionByName(_gauge_panel("pool", g, F.lit("pending")))
    if pipeline is not None:
        d = C.counter_deltas(pipeline, ["name"])
        r = C.rate_series(d, ["name"], start_us, end_us, step_us, rate_us, mode="exact")
        out = out.unionByName(r.select(F.lit("pipeline").alias("panel"), F.col("name").alias("series"),
                                       "step_us", F.col("rate").alias("value")))
    if heap is not None:
        by_service = "service" in heap.columns
        used = heap.where(F.col("area") == "heap") if by_service else heap
        labels = [c for c in heap.columns if c not in ("ts_us", "value")]     # pools are series of their own
        g = C.gauge_series(used, labels, start_us, end_us, step_us)
        out = out.unionByName(_gauge_panel("heap", g, F.col("service" if by_service else "area")))
    return out


def _gauge_panel(panel: str, series: DataFrame, name) -> DataFrame:
    """`sum by (name)` of gauge series as panel rows."""
    return series.groupBy(name.alias("series"), "step_us").agg(F.sum("value").alias("value")).select(
        F.lit(panel).alias("panel"), "series", "step_us", "value")


def dashboard_panels(requests: DataFrame, start_us: int, end_us: int, step_us: int, **tables) -> DataFrame:
    pts = panel_points(requests, start_us, end_us, step_us, **tables)
    return SR.last_non_null(pts, ["panel", "series"])
