import pytest
from pyspark.sql import functions as F

from telespark.plans.metrics import query_metrics, validate
from telespark.plans.status import empty_reason
from telespark.plans.window import Window

M = 1_000_000
SCHEMA = "request_id bigint, ts_us bigint, service string, route string, status int, duration_ms double"


def test_validation():
    with pytest.raises(ValueError):
        validate("throughput", "all", 95)
    with pytest.raises(ValueError):
        validate("latency", "payments", 95)
    with pytest.raises(ValueError):
        validate("latency", "all", 90)
    with pytest.raises(ValueError):
        validate("db_pool", "orders", 95)
    validate("db_pool", "inventory", 95)


def test_empty_reasons(spark):
    rows = [(1, 10 * M, "orders", "/orders", 500, 5.0), (2, 500 * M, "orders", "/orders", 200, 5.0),
            (3, 500 * M, "gateway", "/api", 200, 5.0), (4, 510 * M, "gateway", "/chaos/x", 501, 5.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    win = Window(400 * M, 900 * M)
    r = {s: empty_reason(df, "error_rate", s, win, 1000 * M, 24).first() for s in ("orders", "gateway")}
    assert r["orders"].reason == "no_samples_in_window" and r["orders"].value == 0
    assert r["gateway"].reason == "series_absent" and r["gateway"].value == 0   # a /chaos 501 does not count
    lat = empty_reason(df, "latency", "gateway", win, 1000 * M, 24).first()
    assert lat.reason == "ok" and lat.status == "ok" and lat.value is None


def test_query_metrics_shapes(spark):
    rows = [(i, (i * 37) % 3600 * M, ["gateway", "orders"][i % 2], "/api", 500 if i % 9 == 0 else 200,
             float(i % 300)) for i in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA)
    win = Window(0, 3600 * M)
    out = query_metrics(df, "latency", win, 3600 * M)
    series = {r.service: r for r in out["series"].collect()}
    assert set(series) == {"gateway", "orders"}
    assert series["gateway"].p50 <= series["gateway"].p95 <= series["gateway"].p99
    pts = out["points"]
    assert pts.groupBy("service").count().agg(F.max("count")).first()[0] <= 12
    assert out["status"].first().reason == "ok"
    rate = {r.service: r for r in query_metrics(df, "request_rate", win, 3600 * M)["series"].collect()}
    assert rate["gateway"].points == rate["orders"].points          # dense grid
    ratio = query_metrics(df, "error_ratio", win, 3600 * M, service="orders")["series"].collect()
    assert [r.service for r in ratio] == ["orders"]


def test_dashboard_with_heap_panel(spark):
    from telespark.plans.dashboard import dashboard_panels
    req = spark.createDataFrame([(i, i * 60 * M, "orders", "/orders", 500 if i % 4 == 0 else 200, 20.0 + i)
                                 for i in range(120)], SCHEMA)
    heap = spark.createDataFrame([(t * 60 * M, "heap", float(100 + t)) for t in range(0, 121, 5)],
                                 "ts_us bigint, area string, value double")
    got = {(r.panel, r.series): r for r in dashboard_panels(req, 0, 7200 * M, 3600 * M, heap=heap).collect()}
    assert {p for p, _ in got} == {"request_rate", "p95_ms", "errors_5xx", "heap"}
    assert got[("heap", "heap")].last == 220.0
    assert got[("errors_5xx", "orders")].max > 0


def test_status_degraded_without_data(spark):
    from telespark.plans.status import telemetry_status
    df = spark.createDataFrame([(1, 10 * M, "orders", "/orders", 200, 1.0)], SCHEMA)
    st = telemetry_status(df, spark, 10 * 86400 * M, 24).first()
    assert st.status == "degraded" and st.oldest_us is None
    assert st.reporting == "" and st.not_reporting == "gateway,inventory,orders"
