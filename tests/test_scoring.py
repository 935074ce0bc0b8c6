from pyspark.sql import functions as F

from telespark.plans import scoring as SC

INC = "incident_id string, service string, fault_type string, start_us bigint, end_us bigint"
CHK = ("incident_id string, name string, metric string, service string, expect string, "
       "min_delta double, tolerance double, unit string")
M = 1_000_000


def test_verdicts(spark):
    inc = spark.createDataFrame([("r/i1", "inventory", "latency", 100 * M, 400 * M)], INC)
    checks = spark.createDataFrame([
        ("r/i1", "up", "p95", "inventory", "rise", 0.1, None, "s"),
        ("r/i1", "down", "idle", "inventory", "fall", 1.0, None, "c"),
        ("r/i1", "flat", "p95", "gateway", "flat", None, 0.1, "s"),
        ("r/i1", "missing", "p95", "orders", "rise", 0.1, None, "s")], CHK)
    pts = [("p95", "inventory", t * M, v) for t, v in [(10, .02), (20, .03), (30, .04), (120, .9), (160, .5), (200, .6)]]
    pts += [("idle", "inventory", t * M, v) for t, v in [(10, 3.0), (20, 3.0), (200, 0.0)]]
    pts += [("p95", "gateway", t * M, v) for t, v in [(10, .05), (20, .05), (200, .2), (300, -.01)]]
    pts += [("p95", "inventory", 140 * M, None)]
    points = spark.createDataFrame(pts, "metric string, service string, step_us bigint, value double")
    got = {r.metric: r for r in SC.verify_signals(points, inc, checks, 0, 50 * M).collect()}
    assert got["up"].verdict == "YES" and got["up"].before == 0.03 and got["up"].during == 0.6
    assert got["up"].samples == 2                          # settle skips 120 s; the null point is dropped
    assert got["down"].verdict == "YES" and got["down"].during == 0.0
    assert got["flat"].verdict == "MOVED" and got["flat"].during == 0.2
    assert got["missing"].verdict == "NO DATA" and got["missing"].samples == 0
    lines = SC.format_signals(SC.verify_signals(points, inc, checks, 0, 50 * M)).collect()
    assert any("n/a" in r.line and "**NO DATA**" in r.line for r in lines)


def test_dominance_orphan_and_info(spark):
    schema = ("trace_id bigint, span_id bigint, parent_span_id bigint, service string, "
              "start_us bigint, duration_us bigint, status int")
    spans = spark.createDataFrame([(1, 1, None, "gateway", 10, 100, 200), (1, 2, 1, "inventory", 11, 95, 200),
                                   (2, 1, None, "gateway", 510, 100, 200), (2, 2, 1, "orders", 511, 20, 200)], schema)
    from telespark.operators import spans as S
    labels = spark.createDataFrame([("r/i1", "inventory", "latency", 0, 100),
                                    ("r/i2", "orders", "error_rate", 500, 600)], INC)
    evidence = labels.union(spark.createDataFrame([("r/i7", "x", "latency", 900, 1000)], INC))
    got = {r.incident_id: r for r in SC.verify_dominance(S.self_time(spans), labels, evidence).collect()}
    assert got["r/i1"].verdict == "ok" and got["r/i1"].top_service == "inventory"
    assert round(got["r/i1"].top_pct, 3) == 95.0
    assert got["r/i2"].verdict == "info"
    assert got["r/i7"].verdict == "ORPHAN"


def test_recovery_inert(spark):
    inc = spark.createDataFrame([("r/i1", "inventory", "latency", 100 * M, 200 * M),
                                 ("r/i2", "orders", "error_rate", 150 * M, 300 * M)], INC)
    reqs = [(i, (10 + i) * M, "gateway", "/api/orders", 200, 50.0) for i in range(60)]
    reqs += [(100 + i, (201 + i) * M, "gateway", "/api/orders", 500 if i == 3 else 200, 90.0) for i in range(20)]
    reqs += [(200 + i, (301 + i) * M, "gateway", "/api/orders", 200, 80.0) for i in range(20)]
    df = spark.createDataFrame(reqs, "request_id bigint, ts_us bigint, service string, route string, status int, duration_ms double")
    got = {r.incident_id: r for r in SC.verify_recovery(df, inc, 0, 60 * M).collect()}
    assert got["r/i1"].inert is False and got["r/i1"].probe_failures == 1 and not got["r/i1"].recovered
    assert got["r/i2"].inert is True and got["r/i2"].recovered and got["r/i2"].probes == 10
    assert got["r/i2"].probe_ceiling_ms == 400.0


def test_annotations(spark):
    inc = spark.createDataFrame([("r/i1", "inventory", "latency", 1000, 5000),
                                 ("r/i2", "orders", "error_rate", 3000, 9000)], INC)
    a = {r.incident_id: r for r in SC.annotations(inc).collect()}
    assert a["r/i1"].tags == ["chaos", "inventory", "latency"] and a["r/i1"].time_ms == 1
    pts = spark.createDataFrame([(t, 1.0) for t in (0, 2000, 4000, 8000)], "step_us bigint, value double")
    got = {r.step_us: r.incidents for r in SC.annotate(pts, inc, ("chaos",)).collect()}
    assert got == {0: "", 2000: "r/i1", 4000: "r/i1,r/i2", 8000: "r/i2"}
    got2 = {r.step_us: r.incidents for r in SC.annotate(pts, inc, ("chaos", "latency")).collect()}
    assert got2[4000] == "r/i1"
