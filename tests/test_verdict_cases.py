"""Cases that the fixture lacks: map columns, missing statuses, redirects, large values."""

from pyspark.sql import functions as F

from telespark.functions.scalars import format_value
from telespark.operators.topn import top_n_per_group
from telespark.plans.scoring import _raw_span_json


def test_top_n_with_a_map_column(spark):
    df = spark.range(10).select("id", (F.col("id") % 2).alias("g"),
                                F.create_map(F.lit("k"), F.lit("v")).alias("tags"))
    got = top_n_per_group(df, ["g"], [F.col("id").desc()], 2)
    assert sorted((r.g, r.id) for r in got.collect()) == [(0, 6), (0, 8), (1, 7), (1, 9)]


def test_format_value_has_no_thousands_separator(spark):
    df = spark.createDataFrame([(1234.5,), (None,)], "v double").select(format_value("v").alias("x"))
    assert [r.x for r in df.collect()] == ["1234.500", "n/a"]


def test_span_without_status_has_bytes(spark):
    df = spark.createDataFrame([("t", "s", None, "svc", 1, 2, None)],
                               "trace_id string, span_id string, parent_span_id string, service string, "
                               "start_us long, duration_us long, status int")
    text = df.select(_raw_span_json(df).alias("x")).first().x
    assert text is not None and text.endswith('"value":null}]}')


def test_deep_tree_with_long_ids(spark):
    from telespark.plans.traces import trace_tree
    ids = ["x" * 40 + f"{i:04d}" for i in range(300)]
    rows = [("t", ids[i], ids[i - 1] if i else None, "gateway", i, 10, 200) for i in range(300)]
    rows += [("t", "loop-a", "loop-b", "orders", 5, 1, 200), ("t", "loop-b", "loop-a", "orders", 6, 1, 200),
             ("t", "below", "loop-a", "orders", 7, 1, 200)]
    df = spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, service string, "
                                     "start_us bigint, duration_us bigint, status int")
    tree = trace_tree(df).orderBy("path").collect()
    assert [(r.span_id, r.depth) for r in tree] == [(s, i) for i, s in enumerate(ids)]


def test_limit_out_of_range_is_refused(spark):
    import pytest
    from telespark.plans.traces import query_traces
    with pytest.raises(ValueError):
        query_traces(spark.range(1), "gateway", 0, 1, limit=41)


def test_capped_listing_keeps_self_time(spark):
    from telespark.plans.api import TelemetryStore
    rows = [("a1", 1, None, "gateway", 0, 100, 200), ("a1", 2, 1, "orders", 10, 60, 200)]
    df = spark.createDataFrame(rows, "trace_id string, span_id int, parent_span_id int, service string, "
                                     "start_us bigint, duration_us bigint, status int")
    got = TelemetryStore(spans=df, as_of_us=0).get_trace("a1", cap=1)
    assert [(r.span_id, r.self_us) for r in got["tree"].collect()] == [(1, 40)]
    assert got["truncated"].first().truncated


def test_duration_column_equals_the_argument_form(spark):
    from telespark.functions.time import duration_seconds, parse_duration
    texts = ["15m", " 2h ", "1d", "90s", "0m", "15", "1w", "123456s", "-5m", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", duration_seconds("t").alias("s")).collect():
        try:
            want = parse_duration(r.t)
        except ValueError:
            want = None
        assert r.s == want, r.t


def test_metric_status_follows_the_points(spark):
    from telespark.plans.metrics import query_metrics
    from telespark.plans.window import Window
    us = 1_000_000
    rows = [(1, 996 * us, "orders", "/orders", 200, 5.0), (2, 995 * us, "orders", "/orders", 200, 5.0)]
    df = spark.createDataFrame(rows, "request_id bigint, ts_us bigint, service string, route string, "
                                     "status int, duration_ms double")
    win = Window(1000 * us, 1900 * us)
    rate = query_metrics(df, "request_rate", win, 2000 * us)
    assert rate["status"].first().status == "ok" and rate["points"].count() > 0
    # no failed request: no ratio, and no series of zeros
    ratio = query_metrics(df, "error_ratio", win, 2000 * us)
    assert ratio["series"].count() == 0 and ratio["status"].first().status == "empty"
    pool = spark.createDataFrame([(1500 * us, "other-pool", "used", 3.0)],
                                 "ts_us bigint, pool_name string, state string, value double")
    other = query_metrics(df, "db_pool", win, 2000 * us, gauges=pool)
    assert other["series"].count() == 0 and other["status"].first().status == "empty"


REQ = "request_id long, ts_us long, service string, route string, status int, duration_ms double"


def test_status_at_a_ragged_end(spark):
    """A window of 64 s: its last point is before the only request, so nothing is shown."""
    from telespark.plans.metrics import query_metrics
    from telespark.plans.window import Window
    end = 10_000 * 1_000_000
    df = spark.createDataFrame([(1, end - 2_000_000, "orders", "/orders", 200, 5.0)], REQ)
    out = query_metrics(df, "request_rate", Window(end - 64_000_000, end), end)
    assert out["points"].count() == 0 and out["series"].count() == 0
    s = out["status"].first()
    assert (s.status, s.reason) == ("empty", "no_samples_in_window")


def test_recovery_needs_all_probes(spark):
    from telespark.plans import scoring as SC
    rows = [(i, i * 1_000_000, "gateway", "/api", 200, 10.0) for i in range(100)]
    df = spark.createDataFrame(rows, REQ)
    inc = spark.createDataFrame([("a", "orders", "latency", 40_000_000, 50_000_000), ("b", "orders", "latency", 60_000_000, 97_000_000),
                                 ("c", "orders", "latency", 60_000_000, 99_000_000)],
                                "incident_id string, service string, fault_type string, start_us long, end_us long")
    got = {r.incident_id: (r.probes, r.recovered, r.state) for r in SC.verify_recovery(df, inc.where("incident_id <> 'c'"), 0, 30_000_000).collect()}
    assert got == {"a": (10, True, "recovered"), "b": (2, False, "too few probes")}
    got = {r.incident_id: r.state for r in SC.verify_recovery(df, inc.where("incident_id = 'c'"), 0, 30_000_000).collect()}
    assert got == {"c": "too few probes"}


def test_annotate_keeps_equal_points_and_maps(spark):
    from pyspark.sql import functions as F
    from telespark.plans import scoring as SC
    inc = spark.createDataFrame([("r/i1", "orders", "latency", 0, 10_000)],
                                "incident_id string, service string, fault_type string, start_us long, end_us long")
    pts = spark.createDataFrame([(5_000, 1.0), (5_000, 1.0), (50_000, 1.0), (None, 2.0)], "step_us long, value double")
    got = SC.annotate(pts.withColumn("m", F.create_map(F.lit("a"), F.lit(1))), inc).collect()
    assert sorted((r.step_us or -1, r.incidents) for r in got) == [(-1, ""), (5_000, "r/i1"), (5_000, "r/i1"), (50_000, "")]
