"""Folding only the traces of a window, and the prefix scan of very large parents."""

import json
import random

import pytest
from pyspark.sql import functions as F

from telespark.operators import spans as S
from telespark.plans import scoring as SC
from telespark.sources.sinks import export_traces

SPAN = "trace_id long, span_id long, parent_span_id long, service string, start_us long, duration_us long, status int"


def plan_of(df):
    return df._jdf.queryExecution().toString()


def pushed_filters(df):
    text = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return next(line for line in text.splitlines() if line.startswith("PushedFilters"))


@pytest.fixture()
def store(spark, tmp_path):
    """400 traces, one every 1,000 µs, of a gateway root and two children; every tenth trace is
    started by orders, every seventh has a lost root."""
    rows = []
    for t in range(400):
        at = 1000 * t
        root = "orders" if t % 10 == 0 else "gateway"
        if t % 7:
            rows.append((t, 1, None, root, at, 900, 200))
        rows.append((t, 2, 1, root if t % 7 == 0 else "orders", at + 10, 400, 200))
        rows.append((t, 3, 2, "inventory", at + 20, 300, 500))
    path = str(tmp_path / "spans")
    spark.createDataFrame(rows, SPAN).write.parquet(path)
    return spark.read.parquet(path)


def windows(spark, rows, schema="incident_id string, service string, fault_type string, start_us long, end_us long"):
    return spark.createDataFrame(rows, schema)


ROWS = [("r/a", "gateway", "latency", 10_000, 30_000), ("r/b", "orders", "latency", 25_000, 60_010),
        ("r/none", "orders", "error_rate", 900_000, 990_000)]


def by_folding_everything(store, rows):
    folded = [r for r in S.fold_traces(S.self_time(store)).collect() if r.root_service == "gateway"]
    return {i: [r for r in folded if a <= r.start_us <= b] for i, _, _, a, b in rows}


def test_same_traces_as_folding_everything(spark, store):
    want = by_folding_everything(store, ROWS)
    got = SC.traces_in_windows(store, windows(spark, ROWS), "gateway").collect()
    assert sorted((r.incident_id, r.trace_id, r.start_us) for r in got) == sorted(
        (i, r.trace_id, r.start_us) for i, rs in want.items() for r in rs)
    index = {r.incident_id: (r.traces, r.spans) for r in SC.evidence_index(store, windows(spark, ROWS)).collect()}
    assert index == {i: (len(rs), sum(r.spans for r in rs)) for i, rs in want.items() if rs}
    served = {r.incident_id: r.served_bytes for r in SC.payload_reduction(store, windows(spark, ROWS)).collect()}
    assert served == {i: sum(len(json.dumps({"trace_id": str(r.trace_id), "duration_us": r.duration_us, "spans": r.spans,
                                             "errors": r.errors, "self_us": r.self_us_by_service}, separators=(",", ":")))
                             for r in rs) for i, rs in want.items() if rs}


def test_bounds_reach_the_scan_and_folds_stay_above_the_semi_join(spark, store):
    inc = windows(spark, ROWS)
    pushed = pushed_filters(store.where(SC.scan_bounds(SC.evidence_windows(inc))))
    assert "GreaterThanOrEqual(start_us,10000)" in pushed and "LessThanOrEqual(start_us,60010)" in pushed
    many = windows(spark, [(str(i), "s", "latency", 50 * i, 50 * i + 1) for i in range(200)])
    pushed = pushed_filters(store.where(SC.scan_bounds(SC.evidence_windows(many))))
    assert "GreaterThanOrEqual(start_us,0), LessThanOrEqual(start_us,9951)" in pushed
    plan = plan_of(SC.verify_dominance(store, inc, inc)).split("== Physical Plan ==")[1]
    assert plan.index("Window") < plan.index("LeftSemi")        # printed from the top: the scan of children is above
    # no window: nothing is read
    assert SC.traces_in_windows(store, windows(spark, [("x", "s", "latency", 5, 1)]), "gateway").count() == 0


def test_runtime_bloom_filter_ahead_of_the_span_shuffle(spark, store):
    """At scale Spark puts a bloom filter of the ids under the exchange of the spans."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
                "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        first = store.where(F.col("start_us").between(10, 500)).select("trace_id")
        assert "might_contain" in plan_of(store.join(first, "trace_id", "left_semi"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_confirmed_bounds(spark, store, tmp_path):
    schema = ("incident_id string, service string, fault_type string, start_us long, end_us long, "
              "confirmed_start_us long, confirmed_end_us long")
    rows = [("r/a", "gateway", "latency", 10_000, 30_000, 20_000, 22_000), ("r/b", "gateway", "latency", 10_000, 30_000, None, None)]
    inc = windows(spark, rows, schema)
    got = {r.incident_id: r.traces for r in SC.evidence_index(store, inc).collect()}
    folded = by_folding_everything(store, [("r/a", 0, 0, 20_000, 22_000), ("r/b", 0, 0, 10_000, 30_000)])
    assert got == {i: len(r) for i, r in folded.items()}
    verdicts = {r.incident_id: r.traces for r in SC.verify_dominance(store, inc, inc).collect()}
    assert verdicts == got
    index = {r.incident_id: r.traces for r in export_traces(store, inc, str(tmp_path / "out"), "r").collect()}
    assert index == got


def test_json_is_escaped(spark):
    spans = spark.createDataFrame([(1, 1, None, 'gate"way\\', 10, 5, None)], SPAN).withColumn(
        "operation", F.lit('GET "x"'))
    doc = json.loads(spans.select(SC._raw_span_json(spans).alias("j")).first().j)
    assert doc["operationName"] == 'GET "x"' and doc["references"] == [] and doc["tags"][0]["value"] is None


def test_operation_and_route_of_the_root(spark):
    spans = spark.createDataFrame([(1, 1, None, "gateway", 0, 10, 200, "GET /a", {"http.route": "/a"}),
                                   (1, 2, 1, "orders", 1, 5, 200, "GET /b", {"http.route": "/b"}),
                                   (2, 1, None, "gateway", 0, 10, 200, None, None)],
                                  SPAN + ", operation string, tags map<string,string>")
    got = {r.trace_id: (r.root_operation, r.root_route) for r in S.fold_traces(S.self_time(spans)).collect()}
    assert got == {1: ("GET /a", "/a"), 2: (None, None)}


def test_a_parent_with_very_many_children(spark, monkeypatch):
    """20,000 children within one second, on several tasks."""
    rng = random.Random(9)
    rows = [(1, 0, None, "gateway", 0, 2_000_000, 200)]
    rows += [(1, i, 0, "orders", rng.randrange(1_000_000), rng.choice((0, 3, 40, 900)), 200) for i in range(1, 20_001)]
    rows += [(2, 0, None, "gateway", 0, 100, 200), (2, 1, 0, "orders", 10, 20, 200), (2, 2, 0, "orders", 20, 30, 200)]
    df = spark.createDataFrame(rows, SPAN).repartition(4)
    stored = []
    real = S.materialize
    monkeypatch.setattr(S, "materialize", lambda d: stored.append(real(d)) or stored[-1])
    got = {(r.trace_id, r.span_id): r.self_us for r in S.self_time(df, split_children=4_000).collect()}
    covered = 0
    end = 0
    for _, _, _, _, start, length, _ in sorted(rows[1:20_001], key=lambda r: (r[4], r[1])):
        covered += max(0, start + length - max(start, end))
        end = max(end, start + length)
    assert got[1, 0] == 2_000_000 - covered and got[2, 0] == 60
    ranged = next(d for d in stored if "_range" in d.columns)
    sizes = [r["count"] for r in ranged.groupBy("_range").count().collect()]
    assert sum(sizes) == 20_000 and len(sizes) >= 4 and max(sizes) <= 8_000
    plain = {(r.trace_id, r.span_id): r.self_us for r in S.self_time(df).collect()}
    assert plain == got


def test_few_shuffles(spark, store):
    """One exchange of the children serves window and sum; spans are dealt once."""
    plan = plan_of(S.self_time(store, resolve=False)).split("== Physical Plan ==")[1]
    assert plan.count("Exchange hashpartitioning") <= 2
