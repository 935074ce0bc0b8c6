from pyspark.sql import functions as F

from telespark.functions import (app_routes, fault_metric, id_suffix, is_5xx, is_error_span, is_hex, is_ok,
                                 parse_iso_strict)


def test_app_routes_fully_anchored(spark):
    df = spark.createDataFrame([("/health",), ("/healthz",), ("/chaos/latency",), ("/chaos",),
                                ("/orders",), (None,), ("/api/chaos",)], "route string")
    got = {r.route: r.ok for r in df.select("route", app_routes("route").alias("ok")).collect()}
    assert got == {"/health": False, "/healthz": True, "/chaos/latency": False, "/chaos": False,
                   "/orders": True, None: True, "/api/chaos": True}


def test_status_predicates(spark):
    df = spark.createDataFrame([("200",), ("302",), ("404",), ("500",), ("ConnectionError",), (None,)],
                               "status string")
    got = [r.ok for r in df.select(is_ok("status").alias("ok")).collect()]
    assert got == [True, True, False, False, False, False]
    df2 = spark.createDataFrame([(499,), (500,), (503,), (599,), (600,)], "status int")
    assert [r.e for r in df2.select(is_5xx("status").alias("e")).collect()] == [False, True, True, True, False]


def test_error_span(spark):
    df = spark.createDataFrame([(None, 200), (True, 200), (False, 503), (None, None)],
                               "error boolean, status int")
    assert [r.e for r in df.select(is_error_span().alias("e")).collect()] == [False, True, True, False]


def test_scalars(spark):
    df = spark.createDataFrame([("run-x/i2", "error_rate", "a1B2"), ("i3", "pool_exhaust", "xyz"),
                                ("a/b/c", "weird", "")], "id string, fault string, tid string")
    rows = df.select(id_suffix("id").alias("s"), fault_metric("fault").alias("m"),
                     is_hex("tid").alias("h")).collect()
    assert [(r.s, r.m, r.h) for r in rows] == [("i2", "error_ratio", True), ("i3", "db_pool", False),
                                               ("c", "latency", False)]


def test_parse_iso_strict(spark):
    df = spark.createDataFrame([("2026-08-09T20:17:31.860Z",), ("2026-08-09T22:17:31+02:00",),
                                ("2026-08-09T20:17:31",), ("garbage",)], "t string")
    got = [r.us for r in df.select(parse_iso_strict("t").alias("us")).collect()]
    assert got[0] == 1786306651860000 and got[1] == 1786306651000000
    assert got[2] is None and got[3] is None
