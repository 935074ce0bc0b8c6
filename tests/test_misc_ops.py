from pyspark.sql import functions as F

from telespark.functions import expected_signal, full_fidelity, truncate_text
from telespark.functions.predicates import in_window, retain
from telespark.functions.scalars import round_half_even
from telespark.operators import spans as S
from telespark.operators.series import ratio_series
from telespark.plans.scoring import baseline_windows
from telespark.plans.traces import query_traces
from telespark.sources.labels import run_meta

SCHEMA = ("trace_id bigint, span_id bigint, parent_span_id bigint, service string, "
          "start_us bigint, duration_us bigint, status int")


def test_window_filters(spark):
    df = spark.createDataFrame([(t,) for t in range(0, 100, 10)], "ts_us bigint")
    assert [r.ts_us for r in in_window(df, 20, 50).collect()] == [20, 30, 40, 50]
    assert [r.ts_us for r in retain(df, 90, 20 / 3600 / 1e6).collect()] == [70, 80, 90]


def test_scalars_misc(spark):
    df = spark.createDataFrame([(0.25, 1.0), (0.35, 0.999999999), (float("nan"), 2.0)], "x double, scale double")
    rows = df.select(round_half_even("x", 1).alias("r"), full_fidelity("scale").alias("f")).collect()
    assert [r.r for r in rows] == [0.2, 0.4, None] and [r.f for r in rows] == [True, True, False]
    chk = spark.createDataFrame([([("a", "rise"), ("b", "flat"), ("c", "fall")], "x" * 130)],
                                "checks array<struct<name:string,expect:string>>, t string")
    r = chk.select(expected_signal("checks").alias("e"), truncate_text("t").alias("t")).first()
    assert r.e == ["a", "c"] and len(r.t) == 120


def test_ratio_series_inner(spark):
    num = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 0.0)], "service string, step_us bigint, value double")
    den = spark.createDataFrame([("a", 1, 8.0), ("a", 2, 0.0), ("b", 1, 5.0)], "service string, step_us bigint, value double")
    got = {(r.service, r.step_us): r.value for r in ratio_series(num, den, ["service", "step_us"]).collect()}
    assert got == {("a", 1): 25.0, ("a", 2): None}        # no numerator for b -> no row


def test_dedupe_and_membership(spark):
    rows = [(1, 1, None, "gateway", 0, 10, 200), (1, 2, 1, "inventory", 1, 5, 200),
            (2, 1, None, "gateway", 100, 10, 200), (3, 1, None, "orders", 200, 10, 200)]
    df = spark.createDataFrame(rows + rows[:2], SCHEMA)
    clean = S.distinct_spans(df)
    assert clean.count() == 4
    res = query_traces(clean, "inventory", 0, 300, limit=9, membership="any")
    assert [r.trace_id for r in res["traces"].collect()] == [1]
    res = query_traces(clean, "gateway", 0, 300, limit=9)
    assert sorted(r.trace_id for r in res["traces"].collect()) == [1, 2]


def test_baseline_and_run_meta(spark):
    runs = spark.createDataFrame([("r1", 1_000_000_000)], "run_id string, started_us bigint")
    inc = spark.createDataFrame([("r1", "r1/i1", 1_180_000_000), ("r1", "r1/i2", 1_660_000_000)],
                                "run_id string, incident_id string, start_us bigint")
    b = baseline_windows(runs, inc).first()
    assert (b.baseline_start_us, b.baseline_end_us) == (1_015_000_000, 1_165_000_000)
    sig = spark.createDataFrame([("i1", "YES")], "incident string, verdict string")
    meta = run_meta(spark, "r1", 1_000_000_000, 2_800_000_000, b.baseline_start_us, b.baseline_end_us, inc, sig).first()
    assert meta.incidents == ["r1/i1", "r1/i2"] and meta.started == "1970-01-01T00:16:40Z"
    assert meta.signals[0].verdict == "YES"


def test_nearest_rows_brute_force(spark):
    import random
    from telespark.operators.joins import nearest_rows
    rng = random.Random(9)
    ts = [rng.choice([rng.randint(0, 5_000_000_000), 1_000_000_000]) for _ in range(400)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "request_id bigint, ts_us bigint")
    anchors_l = [-5, 1_000_000_000, 2_500_000_000, 6_000_000_000]
    anchors = spark.createDataFrame([(a,) for a in anchors_l], "at_us bigint")
    for direction in ("before", "after"):
        got = {}
        for r in nearest_rows(rows, anchors, 7, direction, hist_us=100_000_000).collect():
            got.setdefault(r.at_us, []).append((r.rank, r.request_id))
        for a in anchors_l:
            if direction == "before":
                cand = sorted(((t, i) for i, t in enumerate(ts) if t <= a), reverse=True)[:7]
            else:
                cand = sorted((t, i) for i, t in enumerate(ts) if t > a)[:7]
            want = [(k + 1, i) for k, (_, i) in enumerate(cand)]
            assert sorted(got.get(a, [])) == want, (direction, a)


def test_top_n_per_group(spark):
    from telespark.operators.topn import top_n_per_group
    df = spark.createDataFrame([(g, v) for g in range(3) for v in range(100)], "g int, v int")
    got = top_n_per_group(df, ["g"], [F.col("v").desc()], 5, salt=7).collect()
    assert sorted((r.g, r.v, r.rank) for r in got) == sorted((g, 99 - k, k + 1) for g in range(3) for k in range(5))
