import random

import pytest
from pyspark.sql import functions as F

from telespark.operators import panes as P
from telespark.operators import series as SR


def _rows(spark, n=400, seed=3):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", None]), rng.randint(-400, 1100)) for _ in range(n)]
    rows += [("a", t) for t in (0, 100, 200, 1000, 1000, 1001)]          # on the edges of steps, repeated
    return rows, spark.createDataFrame(rows + [("a", None)], "service string, ts_us bigint")


@pytest.mark.parametrize("step,rng,end", [(100, 100, 1000), (100, 300, 1000), (100, 250, 1000), (70, 30, 1000),
                                          (100, 37, 1003), (70, 1000, 999), (300, 100, 950), (100, 100, 950)])
def test_step_counts_equal_the_definition(spark, step, rng, end):
    rows, df = _rows(spark)
    want = {}
    for k in range(end // step + 1):
        for s, t in rows:
            if k * step - rng < t <= k * step and t <= end:
                want[s, k * step] = want.get((s, k * step), 0) + 1
    got = P.step_counts(df, ["service"], {"n": F.count(F.lit(1))}, 0, end, step, rng)
    assert {(r.service, r.step_us): r.n for r in got.collect()} == want


def test_two_ranges_share_one_scan(spark, tmp_path):
    rows, df = _rows(spark)
    df.write.parquet(str(tmp_path / "r"))
    stored = spark.read.parquet(str(tmp_path / "r"))
    aggs = {"n": F.count(F.lit(1))}
    both = P.ranged_counts(stored, ["service"], aggs, 0, 1000, 100, {"short": 100, "long": 500})
    got = {(r.range_name, r.service, r.step_us): r.n for r in both.collect()}
    for name, rng in (("short", 100), ("long", 500)):
        alone = P.step_counts(stored, ["service"], aggs, 0, 1000, 100, rng).collect()
        assert {(s, t): n for (r, s, t), n in got.items() if r == name} == {(r.service, r.step_us): r.n for r in alone}
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
    # the rows are counted below the fan-out
    assert plan.rindex("Aggregate") > plan.rindex("Generate")


def test_rows_are_not_multiplied(spark):
    """A thousand rows of one pane are one row where the steps are assigned."""
    df = spark.range(1000).select(F.lit("a").alias("service"), F.lit(5).cast("bigint").alias("ts_us"))
    panes = P.pane_aggregate(df, ["service"], {"n": F.count(F.lit(1))}, 0, 1000, P.pane_width(10, 500), 500)
    assert [(r.pane_us, r.n) for r in panes.collect()] == [(10, 1000)]
    assert SR.assign_steps(panes, 0, 1000, 10, 500, ts="pane_us").count() == 50


def test_empty_table_and_bad_widths(spark):
    df = spark.createDataFrame([], "service string, ts_us bigint")
    assert P.step_counts(df, ["service"], {"n": F.count(F.lit(1))}, 0, 100, 10, 30).count() == 0
    with pytest.raises(ValueError):
        P.pane_width(0, 10)
    with pytest.raises(ValueError):
        P.pane_width(10, -5)


def test_dashboard_ranges_apart_from_the_step(spark):
    from telespark.plans.dashboard import panel_points
    m = 60_000_000
    rows = [(i, i * m // 2, "orders", r, 500 if i % 4 == 0 else 200, 10.0 + i) for i in range(1, 61)
            for r in ("/orders", "/health", "/chaos/x", None)]
    req = spark.createDataFrame(rows, "request_id int, ts_us bigint, service string, route string, status int, duration_ms double")
    heap = spark.createDataFrame([(t * m, s, a, p, float(t + w)) for t in range(31) for s, w in (("orders", 1), ("gateway", 2))
                                  for a in ("heap", "nonheap") for p in ("eden", "old")],
                                 "ts_us bigint, service string, area string, pool string, value double")
    pend = spark.createDataFrame([("inventory-pool", t * m, float(t)) for t in range(31)] + [("other", 0, 9.0)],
                                 "pool_name string, ts_us bigint, value double")
    got = panel_points(req, 0, 30 * m, 10 * m, heap=heap, pending=pend, rate_range_us=m, quantile_range_us=5 * m).collect()
    v = {(r.panel, r.series, r.step_us // m): r.value for r in got}
    # two half-minute instants a minute, two application routes (a missing route counts)
    assert [v["request_rate", "orders", t] for t in (0, 10, 20, 30)] == [0.0, 4 / 60, 4 / 60, 4 / 60]
    # 5xx leave out only the control plane: at minutes 10, 20, 30 the instants 20, 40, 60 are errors
    assert [v.get(("errors_5xx", "orders", t)) for t in (0, 10, 20, 30)] == [None, 3 / 60, 3 / 60, 3 / 60]
    assert ("p95_ms", "orders", 0) not in v and 25.0 < v["p95_ms", "orders", 10] <= 50.0
    assert v["heap", "gateway", 30] == 64.0 and v["heap", "orders", 0] == 2.0
    assert v["pool", "pending", 20] == 20.0
