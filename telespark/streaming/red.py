"""Structured Streaming forms of the RED rollups and silent-service detection
(O-90, O-91, O-92).

Every stream function has a batch twin built from the same aggregation, so a
stream can be checked against a batch recompute of the same rows (the batch
recompute is the truth for rows the watermark dropped).
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import app_routes, is_5xx
from ..sources.views import BUCKET_BOUNDS_MS


def with_event_time(requests: DataFrame) -> DataFrame:
    """Adds `ts` (TIMESTAMP) from ts_us for event-time windows."""
    return requests.withColumn("ts", F.timestamp_micros(F.col("ts_us")))


def _red_aggs(bounds=BUCKET_BOUNDS_MS):
    aggs = [F.count(F.lit(1)).alias("requests"), F.count_if(is_5xx("status")).alias("errors_5xx")]
    # cumulative `le` counts, so histogram quantiles can be merged later
    aggs += [F.count_if(F.col("duration_ms") <= F.lit(float(b))).alias(f"le_{str(b).replace('.', '_')}")
             for b in bounds]
    return aggs


def _micros(spark, interval: str) -> int:
    return spark.range(1).select(F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"INTERVAL {interval}"))).first()[0]


def red_rollup(events: DataFrame, window: str = "15 seconds", slide: str | None = None) -> DataFrame:
    """Per event-time window and service: requests, 5xx and cumulative bucket counts,
    application routes only. Works on a batch or a streaming DataFrame (give the
    streaming one a watermark first).

    Sliding windows are put together from tumbling panes of the common divisor of window
    and slide: a row is counted once, and only pane rows (one per pane and service) go to
    the window/slide windows that hold them. In a stream these are two chained stateful
    aggregations; the second sees a pane once the watermark has closed it.
    """
    names = ["requests", "errors_5xx"] + [f"le_{str(b).replace('.', '_')}" for b in BUCKET_BOUNDS_MS]
    pane = window
    if slide:
        pane = f"{gcd(_micros(events.sparkSession, window), _micros(events.sparkSession, slide))} microseconds"
    out = events.where(app_routes("route")).groupBy(F.window("ts", pane).alias("w"), "service").agg(*_red_aggs())
    if slide:
        out = (out.groupBy(F.window(F.window_time("w"), window, slide).alias("w"), "service")
               .agg(*[F.sum(n).alias(n) for n in names]))
    return out.select(F.unix_micros(F.col("w.start")).alias("window_start_us"),
                      F.unix_micros(F.col("w.end")).alias("window_end_us"), "service", *names)


def red_rollup_stream(stream: DataFrame, window: str = "15 seconds", watermark: str = "30 seconds",
                      slide: str | None = None) -> DataFrame:
    """Streaming RED rollup: watermark on event time, tumbling (or sliding) windows,
    append output mode (a window is emitted once the watermark passes its end)."""
    return red_rollup(with_event_time(stream).withWatermark("ts", watermark), window, slide)


def sliding_panels_stream(stream: DataFrame, window: str = "5 minutes", slide: str = "15 seconds",
                          watermark: str = "30 seconds") -> DataFrame:
    """Dashboard panels as sliding windows (left-closed in Spark; PromQL is right-closed)."""
    return red_rollup_stream(stream, window, watermark, slide)


SILENCE_US = 300 * 1000000
_SLOT_US = 60 * 1000000


def _stretches(sessions: DataFrame, silence_us: int) -> DataFrame:
    return sessions.select("service", "last_seen_us", (F.col("last_seen_us") + F.lit(silence_us)).alias("silent_after_us"))


def silent_services_stream(stream: DataFrame, watermark: str = "1 minute", silence_us: int = SILENCE_US) -> DataFrame:
    """Emit (service, last_seen_us, silent_after_us) for every stretch in which a
    service sent nothing for longer than `silence_us` of event time.

    A service's rows form sessions with that gap (sessions that touch are one, so a row
    exactly `silence_us` later still belongs); a session is emitted once the watermark
    reaches its end, whether a later row closed it or nothing came at all. State is one session per service, kept by Spark's own session store, so the output
    does not depend on how the stream was cut into micro-batches.
    """
    ev = with_event_time(stream.where(F.col("service").isNotNull())).withWatermark("ts", watermark)
    gap = f"{silence_us} microseconds"
    return _stretches(ev.groupBy(F.session_window("ts", gap).alias("w"), "service")
                      .agg(F.max("ts_us").alias("last_seen_us")), silence_us)


def silent_stretches(requests: DataFrame, as_of_us: int, silence_us: int = SILENCE_US) -> DataFrame:
    """Batch twin of `silent_services_stream` over the rows up to `as_of_us`: a stretch
    still open then counts once it is longer than the silence.

    Rows are first reduced to their first and last instant per service and slot (a slot
    is no longer than the silence, so it holds no stretch); sessions are made of those,
    so that a service with most of the rows is a few rows per hour.
    """
    slot = min(_SLOT_US, silence_us + 1)
    slots = (requests.where(F.col("service").isNotNull() & (F.col("ts_us") <= as_of_us))
             .groupBy("service", F.floor(F.col("ts_us") / slot).alias("slot"))
             .agg(F.min("ts_us").alias("ts_us"), F.max("ts_us").alias("last")))
    gap = F.concat((F.col("last") - F.col("ts_us") + F.lit(silence_us)).cast("string"), F.lit(" microseconds"))
    sessions = (with_event_time(slots).groupBy(F.session_window("ts", gap).alias("w"), "service")
                .agg(F.max("last").alias("last_seen_us")))
    return _stretches(sessions, silence_us).where(F.col("silent_after_us") < as_of_us)


LATE_SCHEMA = "query_id string, batch_id long, watermark string, input_rows long, dropped_rows long"


def late_account(query) -> DataFrame:
    """Rows per micro-batch that the watermark dropped, from the progress a query has
    kept (spark.sql.streaming.numRecentProgressUpdates batches); one row per batch."""
    rows = {}
    for p in query.recentProgress:
        dropped = sum(op.get("numRowsDroppedByWatermark", 0) for op in p.get("stateOperators", []))
        key = (str(p["id"]), int(p["batchId"]))
        old = rows.get(key, (None, 0, 0))
        rows[key] = (p.get("eventTime", {}).get("watermark", old[0]), max(old[1], int(p["numInputRows"])), max(old[2], dropped))
    return SparkSession.active().createDataFrame([(*k, *v) for k, v in sorted(rows.items())], LATE_SCHEMA)


def repair_rollup(rollup: DataFrame, requests: DataFrame, window: str = "15 seconds", slide: str | None = None) -> DataFrame:
    """A streamed rollup with the windows that lost late rows replaced by the batch
    recompute of `requests`, every row that arrived; `repaired` marks them.

    Only windows the stream has emitted up to its last closed one are compared (later
    ones are still open). A window with late rows only was never emitted: it is added.
    """
    key = ["window_start_us", "window_end_us", "service"]
    done = rollup.agg(F.max("window_end_us").alias("_done"))
    truth = red_rollup(with_event_time(requests), window, slide)
    truth = truth.join(done, truth["window_end_us"] <= F.col("_done")).drop("_done")
    had = rollup.select(*key, F.col("requests").alias("_n"))
    out = truth.join(had, key, "left")
    # rows only get lost: equal counts are equal windows
    return out.withColumn("repaired", ~F.col("_n").eqNullSafe(F.col("requests"))).drop("_n")


def start_red_rollup(spark, source_path: str, sink_path: str, checkpoint_path: str,
                     schema, window: str = "15 seconds", watermark: str = "30 seconds",
                     trigger: dict | None = None, max_files_per_trigger: int | None = None):
    """End-to-end job: parquet request files arriving in `source_path` -> RED rollup
    per event-time window -> parquet files appended to `sink_path`.

    `checkpoint_path` must be on shared storage: offsets and aggregation state
    live there, so a restarted driver or lost executor resumes exactly where it
    stopped. `trigger` is passed to DataStreamWriter.trigger (e.g.
    {"processingTime": "15 seconds"} or {"availableNow": True}).
    """
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    out = red_rollup_stream(reader.parquet(source_path), window, watermark)
    writer = (out.writeStream.format("parquet").outputMode("append")
              .option("path", sink_path).option("checkpointLocation", checkpoint_path))
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.start()


def rollup_quantiles(rollups: DataFrame, keys, qs: dict, bounds=BUCKET_BOUNDS_MS) -> DataFrame:
    """Percentiles from RED rollups merged over `keys` (e.g. service and day): the
    cumulative `le_*` counts and the request total add up across windows, are
    turned into (le, cum) rows and fed to histogram_quantile."""
    from ..operators.counters import histogram_quantile
    keys = list(keys)
    names = [f"le_{str(b).replace('.', '_')}" for b in bounds]
    summed = rollups.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names],
                                        F.sum("requests").alias("requests"))
    pairs = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(c).alias("cum"))
                      for b, c in zip(bounds, names)],
                    F.struct(F.lit(float("inf")).alias("le"), F.col("requests").alias("cum")))
    rows = summed.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.le", "p.cum")
    return histogram_quantile(rows, keys, qs, cum_col="cum")
