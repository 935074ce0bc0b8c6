"""Q-4 telemetry coverage and empty-result explanation (O-29, O-30, O-50..O-52, O-72)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import OLDEST_GRID_S, REPORTING_LOOKBACK_S, SERVICES
from ..functions.predicates import app_routes, is_5xx
from ..operators import series as SR
from ..operators.joins import join_single_rows
from ..operators.panes import step_counts

US = 1_000_000
_ERROR_METRICS = ("error_rate", "error_ratio")


def _selector(df: DataFrame, metric: str, service: str) -> DataFrame:
    """The same selector the metric query uses (5xx filter included for error metrics)."""
    out = df
    if metric == "db_pool" and "pool_name" in df.columns:
        out = out.where(F.col("pool_name") == "inventory-pool")
    if service != "all" and "service" in df.columns:
        out = out.where(F.col("service") == service)
    if metric != "db_pool" and "route" in df.columns:
        out = out.where(app_routes("route"))
    if metric in _ERROR_METRICS:
        out = out.where(is_5xx("status"))
    return out


def _reasons(agg: DataFrame, metric: str) -> DataFrame:
    """status, reason, value from the counts in_window and in_retention."""
    reason = (F.when(F.col("in_window") > 0, "ok").when(F.col("in_retention") == 0, "series_absent")
              .otherwise("no_samples_in_window"))
    value = F.when((F.col("reason") != "ok") & F.lit(metric in _ERROR_METRICS), F.lit(0))
    return (agg.withColumn("reason", reason)
            .withColumn("status", F.when(F.col("reason") == "ok", "ok").otherwise("empty"))
            .withColumn("value", value))


def empty_reason(df: DataFrame, metric: str, service: str, win, as_of_us: int,
                 retention_hours: float) -> DataFrame:
    """One row: status, reason, value.

    reason: 'ok' when the window holds samples of the selected series,
    'no_samples_in_window' when it exists elsewhere in retention, 'series_absent'
    when it never existed in retention. Error metrics report value 0 in both empty
    cases (zero errors is a measured answer); others report null. A single
    aggregate with two conditional counts.
    """
    horizon = as_of_us - int(retention_hours * 3600 * US)
    agg = _selector(df, metric, service).agg(
        F.count_if(F.col("ts_us").between(horizon, as_of_us)).alias("in_retention"),
        F.count_if((F.col("ts_us") > win.start_us) & (F.col("ts_us") <= win.end_us)).alias("in_window"))
    return _reasons(agg, metric).select("status", "reason", "value", "in_window", "in_retention")


def points_reason(points: DataFrame, df: DataFrame, metric: str, service: str, as_of_us: int,
                  retention_hours: float) -> DataFrame:
    """The status of a metric query: empty when its points hold no value, whatever the
    samples (a sample after the last point, or a histogram without counts, gives none)."""
    horizon = as_of_us - int(retention_hours * 3600 * US)
    seen = _selector(df, metric, service).agg(
        F.count_if(F.col("ts_us").between(horizon, as_of_us)).alias("in_retention"))
    valued = points.agg(F.count_if(F.col("value").isNotNull() & ~F.isnan("value")).alias("in_window"))
    return _reasons(join_single_rows(seen, valued), metric).select("status", "reason", "value", "in_window", "in_retention")


def empty_reasons(df: DataFrame, metric: str, expected: DataFrame, start_us: int, end_us: int, step_us: int,
                  as_of_us: int, retention_hours: float) -> DataFrame:
    """service, step_us, status, reason, value, in_window, in_retention: `empty_reason` of every
    expected service in every window (step - step_us, step] at once: one aggregate over the
    retention, one over the windows."""
    horizon = as_of_us - int(retention_hours * 3600 * US)
    sel = _selector(df, metric, "all")
    kept = (sel.where(F.col("ts_us").between(horizon, as_of_us)).groupBy("service")
            .agg(F.count(F.lit(1)).alias("in_retention")))
    inside = step_counts(sel, ["service"], {"in_window": F.count(F.lit(1))}, start_us, end_us, step_us, step_us)
    grid = SR.step_grid(df.sparkSession, expected, start_us, end_us, step_us)
    agg = (grid.join(inside, ["service", "step_us"], "left").join(kept, "service", "left")
           .fillna(0, ["in_window", "in_retention"]))
    return _reasons(agg, metric)


def reporting_services(df: DataFrame, instants_start_us: int, instants_end_us: int, step_us: int,
                       lookback_s: int = REPORTING_LOOKBACK_S) -> DataFrame:
    """(step_us, service) for every service with a sample in (t - lookback, t] at each
    instant t of the grid; blank names dropped."""
    named = df.where(F.col("service").isNotNull() & (F.trim(F.col("service")) != ""))
    st = step_counts(named, ["service"], {"n": F.count(F.lit(1))}, instants_start_us, instants_end_us,
                     step_us, lookback_s * US)
    return st.select("step_us", "service")


def silent_services(reporting: DataFrame, spark, instants_start_us: int, instants_end_us: int,
                    step_us: int, expected=SERVICES) -> DataFrame:
    """Expected services without data at each instant: grid LEFT ANTI reporting."""
    exp = spark.createDataFrame([(s,) for s in expected], "service string")
    grid = SR.step_grid(spark, exp, instants_start_us, instants_end_us, step_us)
    return grid.join(reporting, ["step_us", "service"], "left_anti")


def oldest_queryable(df: DataFrame, as_of_us: int, retention_hours: float,
                     grid_s: int = OLDEST_GRID_S) -> DataFrame:
    """First instant of the evaluation grid (anchored at the retention horizon) at
    or after the oldest retained sample. One row: oldest_us (null when none)."""
    horizon = as_of_us - int(retention_hours * 3600 * US)
    g = grid_s * US
    m = df.where(F.col("ts_us").between(horizon, as_of_us)).agg(F.min("ts_us").alias("_m"))
    return m.select((F.lit(horizon) + F.ceil((F.col("_m") - F.lit(horizon)) / F.lit(g)).cast("bigint")
                     * F.lit(g)).alias("oldest_us"))


def _services_in(df: DataFrame, ts: str, as_of_us: int, lookback_s: int) -> DataFrame:
    named = df.where((F.col(ts) > as_of_us - lookback_s * US) & (F.col(ts) <= as_of_us))
    return named.where(F.col("service").isNotNull() & (F.trim(F.col("service")) != "")).select("service").distinct()


def _names(df: DataFrame, alias: str) -> DataFrame:
    return df.agg(F.array_join(F.array_sort(F.collect_list("service")), ",").alias(alias))


def trace_store_status(spans: DataFrame, spark, as_of_us: int, retention_hours: float,
                       lookback_s: int = REPORTING_LOOKBACK_S, expected=SERVICES) -> DataFrame:
    """One row on the span table: traces_status ('ok' with a span in retention, else
    'degraded'), traces_oldest_us (its first span in retention), traces_retention_hours,
    traces_reporting and traces_not_reporting (services by spans started in the lookback).
    Every span kept is stored, so `traces_sampling` is always_on."""
    horizon = as_of_us - int(retention_hours * 3600 * US)
    seen = spans.where(F.col("start_us").between(horizon, as_of_us))
    rep = _services_in(spans, "start_us", as_of_us, lookback_s)
    exp = spark.createDataFrame([(s,) for s in expected], "service string")
    row = join_single_rows(seen.agg(F.min("start_us").alias("traces_oldest_us")), _names(rep, "traces_reporting"),
                           _names(exp.join(rep, "service", "left_anti"), "traces_not_reporting"))
    return row.select(
        F.when(F.col("traces_oldest_us").isNull(), "degraded").otherwise("ok").alias("traces_status"),
        "traces_oldest_us", F.lit(float(retention_hours)).alias("traces_retention_hours"),
        F.lit("always_on").alias("traces_sampling"), "traces_reporting", "traces_not_reporting")


STORE_NOTE = ("at least one store holds no data in its retention; queries against it are empty "
              "for that reason, not because nothing happened")


def telemetry_status(df: DataFrame, spark, as_of_us: int, retention_hours: float,
                     lookback_s: int = REPORTING_LOOKBACK_S, expected=SERVICES,
                     spans: DataFrame | None = None, trace_retention_hours: float | None = None) -> DataFrame:
    """One row: status, reporting, not_reporting (comma lists, by name), oldest_us.

    With `spans` the row also holds `trace_store_status` and `metrics_status`; `status` is
    then ok only if both stores are, and `note` says so otherwise (null when ok)."""
    rep = _services_in(df, "ts_us", as_of_us, lookback_s)
    exp = spark.createDataFrame([(s,) for s in expected], "service string")
    missing = exp.join(rep, "service", "left_anti")
    old = oldest_queryable(df, as_of_us, retention_hours)
    out = join_single_rows(_names(rep, "reporting"), _names(missing, "not_reporting"), old)   # three single-row aggregates
    out = out.withColumn("status", F.when(F.col("oldest_us").isNull(), "degraded").otherwise("ok"))
    if spans is None:
        return out
    traces = trace_store_status(spans, spark, as_of_us, trace_retention_hours or retention_hours, lookback_s, expected)
    both = join_single_rows(out.withColumnRenamed("status", "metrics_status"), traces)
    both = both.withColumn("status", F.when((F.col("metrics_status") == "ok") & (F.col("traces_status") == "ok"), "ok")
                           .otherwise("degraded"))
    return both.withColumn("note", F.when(F.col("status") != "ok", F.lit(STORE_NOTE)))


def prom_or(left: DataFrame, right: DataFrame, labels) -> DataFrame:
    """PromQL `or`: every left row plus right rows whose label set is absent on the left."""
    return left.unionByName(right.join(left.select(*labels).distinct(), list(labels), "left_anti"))


def series_exists(expected: DataFrame, samples: DataFrame, key: str = "service") -> DataFrame:
    """expected rows with `exists`: a semi-join probe of the samples table."""
    present = expected.join(samples.select(key).distinct(), key, "left_semi").withColumn("exists", F.lit(True))
    return expected.join(present, key, "left").withColumn("exists", F.coalesce("exists", F.lit(False)))
