"""Telemetry views derived from the driver's tables.

requests      one row per HTTP request (from `events`)
requests_faulted  requests with background errors removed and four faults applied
spans         one order = one trace, one line item = one span (from lineitem+orders)
counters      cumulative request counters scraped hourly, reset on day 15
bucket_counts per-(service, route, le) request counts per hour (histogram buckets)
incidents / span_incidents / checks   the labelled faults (tiny literal tables)

Everything is expressed with DataFrame operations only; no fan-out beyond bounded
grids (series x hours, 10 bucket bounds).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.time import epoch_us
from .tables import load_table

# --- fixed values: fixture layout --------------------------------------------------
EPOCH_2024_US = 1704067200000000          # 2024-01-01T00:00:00Z
HOUR_US = 3600 * 1000000
DAY_US = 86400 * 1000000
COUNTER_HOURS = 720                        # hourly counter grid, 30 days
COUNTER_RESET_HOURS = 360                  # counters reset on day 15
BASELINE_START_US = 1704067200000000       # 2024-01-01
BASELINE_END_US = 1704412800000000         # 2024-01-05
BUCKET_BOUNDS_MS = (5.0, 10.0, 25.0, 50.0, 75.0, 100.0, 250.0, 500.0, 750.0, 1000.0)

# The four faults of the fixture (incident_id, service, fault_type, start_us, end_us).
INCIDENT_ROWS = (
    ("run-fx/i1", "inventory", "latency", 1704412800000000, 1704585600000000),
    ("run-fx/i2", "orders", "error_rate", 1704844800000000, 1705017600000000),
    ("run-fx/i3", "inventory", "pool_exhaust", 1705276800000000, 1705449600000000),
    ("run-fx/i4", "gateway", "latency", 1705708800000000, 1705881600000000),
)
# The same four faults placed in the span time domain (orders run 1995..2001),
# 30 days each, so trace evidence can be scored per incident.
SPAN_INCIDENT_ROWS = (
    ("run-fx/i1", "inventory", "latency", 820454400000000, 823046400000000),      # 1996-01-01 +30d
    ("run-fx/i2", "orders", "error_rate", 852076800000000, 854668800000000),      # 1997-01-01 +30d
    ("run-fx/i3", "inventory", "pool_exhaust", 883612800000000, 886204800000000), # 1998-01-01 +30d
    ("run-fx/i4", "gateway", "latency", 915148800000000, 917740800000000),        # 1999-01-01 +30d
)
# Checks per fault (FIXTURES 1.5); thresholds are data, scaled to the fixture's
# request density: p95 deltas in ms, error ratio in percentage points.
CHECK_ROWS = (
    ("run-fx/i1", "p95 inventory", "p95", "inventory", "rise", 150.0, None, "ms"),
    ("run-fx/i1", "p95 gateway (propagated)", "p95", "gateway", "rise", 150.0, None, "ms"),
    ("run-fx/i2", "5xx ratio orders", "error_ratio", "orders", "rise", 5.0, None, "%"),
    ("run-fx/i2", "5xx ratio gateway (cascade)", "error_ratio", "gateway", "rise", 5.0, None, "%"),
    ("run-fx/i3", "hikari used", "pool_used", "inventory", "rise", 5.0, None, "conns"),
    ("run-fx/i3", "hikari idle", "pool_idle", "inventory", "fall", 1.0, None, "conns"),
    ("run-fx/i3", "p95 inventory (expected FLAT)", "p95", "inventory", "flat", None, 100.0, "ms"),
    ("run-fx/i4", "p95 gateway", "p95", "gateway", "rise", 100.0, None, "ms"),
    ("run-fx/i4", "p95 inventory (expected FLAT)", "p95", "inventory", "flat", None, 100.0, "ms"),
)

_INCIDENT_SCHEMA = T.StructType([
    T.StructField("incident_id", T.StringType(), False),
    T.StructField("service", T.StringType(), False),
    T.StructField("fault_type", T.StringType(), False),
    T.StructField("start_us", T.LongType(), False),
    T.StructField("end_us", T.LongType(), False),
])
_CHECK_SCHEMA = T.StructType([
    T.StructField("incident_id", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("metric", T.StringType(), False),
    T.StructField("service", T.StringType(), False),
    T.StructField("expect", T.StringType(), False),
    T.StructField("min_delta", T.DoubleType(), True),
    T.StructField("tolerance", T.DoubleType(), True),
    T.StructField("unit", T.StringType(), False),
])


def incidents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(INCIDENT_ROWS), _INCIDENT_SCHEMA)


def span_incidents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SPAN_INCIDENT_ROWS), _INCIDENT_SCHEMA)


def checks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CHECK_ROWS), _CHECK_SCHEMA)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request_id, ts_us, service, route, status, duration_ms."""
    ev = load_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    u3 = F.col("user_id") % 3
    e20 = F.col("event_id") % 20
    service = F.when(u3 == 0, "gateway").when(u3 == 1, "orders").otherwise("inventory")
    route = (F.when(e20 == 0, "/health").when(e20 == 1, "/chaos/latency")
             .when(u3 == 0, "/api/orders").when(u3 == 1, "/orders").otherwise("/reserve"))
    status = F.when(e20 == 1, 501).when(F.col("event_type") == "error", 500).otherwise(200)
    return ev.select(
        F.col("event_id").alias("request_id"),
        epoch_us(ev, "ts").alias("ts_us"),
        service.alias("service"),
        route.alias("route"),
        status.alias("status"),
        F.col("value").alias("duration_ms"),
    )


def requests_faulted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Background errors removed; i1 slows everything, i2 fails 1 in 5 in orders and
    gateway, i3 changes nothing, i4 slows gateway."""
    r = requests(spark, sf_dir)
    i1, i2, _, i4 = INCIDENT_ROWS
    control = F.col("route").like("/chaos%") | (F.col("route") == "/health")
    in_i1 = F.col("ts_us").between(i1[3], i1[4])
    in_i2 = F.col("ts_us").between(i2[3], i2[4])
    in_i4 = F.col("ts_us").between(i4[3], i4[4])
    status = (F.when(F.col("service").isin("orders", "gateway") & ~control & in_i2
                     & (F.col("request_id") % 5 == 2), 500)
              .when(F.col("status") == 500, 200).otherwise(F.col("status")))
    extra = (F.when(control, 0.0).when(in_i1, 400.0)
             .when((F.col("service") == "gateway") & in_i4, 250.0).otherwise(0.0))
    return r.select("request_id", "ts_us", "service", "route", status.alias("status"),
                    (F.col("duration_ms") + extra).alias("duration_ms"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trace_id, span_id, parent_span_id, service, start_us, duration_us, status.

    Span n of an order has parent n div 2 (a binary tree). The line number is not
    unique, so span ids come from a row_number over every column; that window is
    partitioned by the join key, so it reuses the join's shuffle.
    """
    li = load_table(spark, sf_dir, "lineitem",
                    ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                     "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
                     "l_linestatus", "l_shipdate"])
    od = load_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderdate"])
    od = od.select("o_orderkey", epoch_us(od, "o_orderdate").alias("order_us"))
    j = li.join(od, li.l_orderkey == od.o_orderkey)
    # numbering the lines of one order (a handful per order); same key as the join
    w = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    n = F.col("n")
    return (j.withColumn("n", F.row_number().over(w))
            .select(
                F.col("l_orderkey").alias("trace_id"),
                n.cast("bigint").alias("span_id"),
                F.when(n == 1, F.lit(None).cast("bigint"))
                 .otherwise(F.floor(n / 2).cast("bigint")).alias("parent_span_id"),
                F.when(n == 1, "gateway").when(n <= 3, "orders").otherwise("inventory").alias("service"),
                (F.col("order_us") + (F.col("l_orderkey") % 86400) * 1000000
                 + (n - 1) * 7000).alias("start_us"),
                (F.col("l_quantity").cast("bigint") * 1000
                 + F.when(n == 1, 60000).otherwise(0)).alias("duration_us"),
                F.when((F.col("l_returnflag") == "R") & (n > 3), 500).otherwise(200).alias("status"),
            ))


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative request counters per (service, route, status), scraped hourly.

    A series exists from its first request on; every counter resets at hour 360.
    service, route, status, ts_us, value (DOUBLE).
    """
    r = requests(spark, sf_dir)
    keys = ["service", "route", "status"]
    hour = F.floor((F.col("ts_us") - EPOCH_2024_US) / HOUR_US).cast("bigint")
    per_hour = r.groupBy(*keys, hour.alias("h")).agg(F.count(F.lit(1)).alias("n"))
    births = per_hour.groupBy(*keys).agg(F.min("h").alias("first_h"))
    grid = births.select(*keys, F.explode(F.sequence(F.col("first_h"),
                                                     F.lit(COUNTER_HOURS - 1).cast("bigint"))).alias("h"))
    dense = grid.join(per_hour, keys + ["h"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = (Window.partitionBy(*keys, F.floor(F.col("h") / COUNTER_RESET_HOURS))
         .orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return dense.select(*keys,
                        (F.lit(EPOCH_2024_US) + (F.col("h") + 1) * HOUR_US).alias("ts_us"),
                        F.sum("n").over(w).cast("double").alias("value"))


def bucket_counts(requests_df: DataFrame, step_us: int = HOUR_US,
                  bounds=BUCKET_BOUNDS_MS, start_us: int = EPOCH_2024_US) -> DataFrame:
    """Histogram observations per (service, route, step, le), NOT cumulative in le.

    Each request lands in exactly one bucket (the smallest bound >= its duration,
    else +Inf), so there is no fan-out; cumulative `le` counts are a running sum
    over at most len(bounds)+1 rows per series later on.
    """
    le = None
    for b in bounds:
        cond = F.col("duration_ms") <= F.lit(float(b))
        le = F.when(cond, F.lit(float(b))) if le is None else le.when(cond, F.lit(float(b)))
    le = le.otherwise(F.lit(float("inf")))
    # right-closed steps (t - step, t], like every other series
    step = F.lit(start_us) + F.ceil((F.col("ts_us") - F.lit(start_us)) / F.lit(step_us)).cast("bigint") * F.lit(step_us)
    return (requests_df
            .groupBy("service", "route", step.alias("step_us"), le.alias("le"))
            .agg(F.count(F.lit(1)).alias("n")))


POOL_SIZE = 10
POOL_HOLD = 9          # connections held by the pool-exhaustion fault (i3)


def pool_gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connection-pool gauge of inventory, scraped at every hour end of the 30-day
    grid: `used` = inventory requests in that hour plus the 9 connections held while
    the pool-exhaustion fault (i3) is active, capped at the pool size; `idle` = the
    rest. pool_name, state, ts_us, value (DOUBLE)."""
    r = requests(spark, sf_dir).where(F.col("service") == "inventory")
    hour = F.floor((F.col("ts_us") - EPOCH_2024_US) / HOUR_US).cast("bigint")
    per = r.groupBy(hour.alias("h")).agg(F.count(F.lit(1)).alias("n"))
    grid = spark.range(COUNTER_HOURS).select(F.col("id").alias("h"))
    i3 = INCIDENT_ROWS[2]
    ts = F.lit(EPOCH_2024_US) + (F.col("h") + 1) * HOUR_US
    held = F.when(ts.between(i3[3], i3[4]), F.lit(POOL_HOLD)).otherwise(F.lit(0))
    used = grid.join(per, "h", "left").select(
        ts.alias("ts_us"), F.least(F.coalesce("n", F.lit(0)) + held, F.lit(POOL_SIZE)).alias("used"))
    st = F.explode(F.array(F.struct(F.lit("used").alias("state"), F.col("used").alias("v")),
                           F.struct(F.lit("idle").alias("state"), (F.lit(POOL_SIZE) - F.col("used")).alias("v"))))
    return used.select(F.lit("inventory-pool").alias("pool_name"), "ts_us", st.alias("s")).select(
        "pool_name", F.col("s.state").alias("state"), "ts_us", F.col("s.v").cast("double").alias("value"))


def pool_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests waiting for a connection of the pool, scraped at every hour end that had
    inventory requests: those above the pool size. pool_name, ts_us, value (DOUBLE)."""
    r = requests(spark, sf_dir).where(F.col("service") == "inventory")
    hour = F.floor((F.col("ts_us") - EPOCH_2024_US) / HOUR_US).cast("bigint")
    per = r.groupBy(hour.alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return per.select(F.lit("inventory-pool").alias("pool_name"),
                      (F.lit(EPOCH_2024_US) + (F.col("h") + 1) * HOUR_US).alias("ts_us"),
                      F.greatest(F.col("n") - POOL_SIZE, F.lit(0)).cast("double").alias("value"))


def jvm_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory gauge per service, area and pool at every hour end that had requests: one
    MiB per request in pool `eden`, the sum of durations in KiB in `old`, both of area
    `heap`, and a fixed 64 MiB outside the heap. service, area, pool, ts_us, value (DOUBLE)."""
    hour = F.floor((F.col("ts_us") - EPOCH_2024_US) / HOUR_US).cast("bigint")
    per = requests(spark, sf_dir).groupBy("service", hour.alias("h")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.round("duration_ms").cast("bigint")).alias("d"))
    pools = F.explode(F.array(
        F.struct(F.lit("heap").alias("area"), F.lit("eden").alias("pool"), (F.col("n") * 1048576).alias("v")),
        F.struct(F.lit("heap").alias("area"), F.lit("old").alias("pool"), (F.col("d") * 1024).alias("v")),
        F.struct(F.lit("nonheap").alias("area"), F.lit("metaspace").alias("pool"), F.lit(67108864).cast("bigint").alias("v"))))
    return per.select("service", (F.lit(EPOCH_2024_US) + (F.col("h") + 1) * HOUR_US).alias("ts_us"),
                      pools.alias("p")).select("service", "p.area", "p.pool", "ts_us",
                                               F.col("p.v").cast("double").alias("value"))


def pipeline_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collector counters scraped hourly (cumulative, from each series' first hour):
    accepted = every request's span, sent = those exported (not control traffic),
    refused = control-plane spans. name, ts_us, value (DOUBLE)."""
    r = requests(spark, sf_dir)
    hour = F.floor((F.col("ts_us") - EPOCH_2024_US) / HOUR_US).cast("bigint")
    control = F.col("route").like("/chaos%") | (F.col("route") == "/health")
    per = r.groupBy(hour.alias("h")).agg(
        F.count(F.lit(1)).alias("accepted"), F.count_if(~control).alias("sent"),
        F.count_if(control).alias("refused"))
    long = per.select("h", F.explode(F.array(
        F.struct(F.lit("otelcol_receiver_accepted_spans").alias("name"), F.col("accepted").alias("n")),
        F.struct(F.lit("otelcol_exporter_sent_spans").alias("name"), F.col("sent").alias("n")),
        F.struct(F.lit("otelcol_receiver_refused_spans").alias("name"), F.col("refused").alias("n")))).alias("x"))
    long = long.select("h", F.col("x.name").alias("name"), F.col("x.n").alias("n"))
    w = Window.partitionBy("name").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    return long.select("name", (F.lit(EPOCH_2024_US) + (F.col("h") + 1) * HOUR_US).alias("ts_us"),
                       F.sum("n").over(w).cast("double").alias("value"))


def materialize(df: DataFrame) -> DataFrame:
    """See telespark.session.materialize: without it, every branch of a self-join
    would recompute the derivation."""
    from ..session import materialize as _m
    return _m(df)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def derived_table(spark: SparkSession, name: str, sources: list, build) -> DataFrame:
    """A derived view written once as parquet under `spark.checkpoint.dir` and read
    back: the stored table a production deployment would have. The location is
    keyed by the source files' paths, sizes and modification times, so a changed
    input gets a new table."""
    import hashlib
    from ..session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark)
    sig = hashlib.sha1()
    for src in sources:
        p, fs = _fs(spark, src)
        st = fs.getFileStatus(p)
        sig.update(f"{src}|{st.getLen()}|{st.getModificationTime()};".encode())
    path = f"{base.rstrip('/')}/telespark-tables/{name}-{sig.hexdigest()[:16]}"
    done, fs = _fs(spark, path + "/_SUCCESS")
    if not fs.exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def spans_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The span view as a stored table (see `derived_table`)."""
    from .tables import table_path
    return derived_table(spark, "spans", [table_path(sf_dir, "lineitem"), table_path(sf_dir, "orders")],
                         lambda: spans(spark, sf_dir))
