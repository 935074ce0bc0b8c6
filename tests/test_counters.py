import math

from telespark.operators import counters as C

DAY = 86400 * 1000000
H = 3600 * 1000000


def test_deltas_reset_birth_and_nan(spark):
    rows = [("a", 1 * H, 5.0), ("a", 2 * H, 8.0), ("a", 3 * H, 2.0), ("a", 4 * H, float("nan")),
            ("a", 5 * H, 4.0), ("b", 2 * H, 10.0), ("b", 3 * H, 10.0)]
    df = spark.createDataFrame(rows, "s string, ts_us bigint, value double")
    d = {(r.s, r.ts_us): r.delta for r in C.counter_deltas(df, ["s"]).collect()}
    assert d == {("a", H): 0.0, ("a", 2 * H): 3.0, ("a", 3 * H): 2.0, ("a", 5 * H): 2.0,
                 ("b", 2 * H): 0.0, ("b", 3 * H): 0.0}


def test_day_partition_carry_over_gap(spark):
    # samples two days apart: the carry must come from the last earlier day with data
    rows = [("a", DAY - H, 7.0), ("a", 3 * DAY + H, 9.0), ("a", 3 * DAY + 2 * H, 1.0)]
    df = spark.createDataFrame(rows, "s string, ts_us bigint, value double")
    d = {r.ts_us: (r.delta, r.prev_ts_us) for r in C.counter_deltas(df, ["s"]).collect()}
    assert d[3 * DAY + H] == (2.0, DAY - H)
    assert d[3 * DAY + 2 * H] == (1.0, 3 * DAY + H)
    inc = C.increase_exact(C.counter_deltas(df, ["s"]), ["s"], 0, 10 * DAY).collect()[0]
    assert inc.increase == 3.0


def promql_rate(samples, t, rng_s):
    """Extrapolated rate of one counter series at t over (t-rng, t] (reference algorithm)."""
    pts = [(ts, v) for ts, v in samples if t - rng_s < ts <= t]
    if len(pts) < 2:
        return None
    result = pts[-1][1] - pts[0][1]
    for (_, a), (_, b) in zip(pts, pts[1:]):
        if b < a:
            result += a
    start, end = t - rng_s, t
    to_start, to_end = pts[0][0] - start, end - pts[-1][0]
    sampled = pts[-1][0] - pts[0][0]
    avg = sampled / (len(pts) - 1)
    if result > 0 and pts[0][1] >= 0:
        to_zero = sampled * (pts[0][1] / result)
        if to_zero < to_start:
            to_start = to_zero
    thr = avg * 1.1
    ext = sampled + (to_start if to_start < thr else avg / 2) + (to_end if to_end < thr else avg / 2)
    return result * (ext / sampled) / rng_s


def test_promql_rate_matches_reference_algorithm(spark):
    samples = [(15 * i + 3, float(v)) for i, v in enumerate([3, 5, 9, 9, 12, 2, 4, 8, 8, 20, 21, 30])]
    rows = [("a", ts * 1000000, v) for ts, v in samples]
    df = spark.createDataFrame(rows, "s string, ts_us bigint, value double")
    d = C.counter_deltas(df, ["s"])
    got = {r.step_us // 1000000: r.rate for r in
           C.rate_series(d, ["s"], 0, 180 * 1000000, 30 * 1000000, 60 * 1000000, "promql").collect()}
    for t in range(0, 181, 30):
        want = promql_rate(samples, t, 60)
        if want is None:
            assert t not in got
        else:
            assert math.isclose(got[t], want, rel_tol=1e-9), t


def test_histogram_quantile_edges(spark):
    rows = [("a", 10.0, 2), ("a", 20.0, 2), ("a", float("inf"), 0),      # plain interpolation
            ("b", 10.0, 0), ("b", 20.0, 1), ("b", float("inf"), 9),      # falls in +Inf bucket
            ("c", 10.0, 0), ("c", float("inf"), 0)]                      # no observations
    df = spark.createDataFrame(rows, "g string, le double, n bigint")
    cum = C.cumulative_buckets(df, ["g"])
    got = {r.g: r for r in C.histogram_quantile(cum, ["g"], {"p50": 0.5, "p95": 0.95, "p25": 0.25}).collect()}
    assert got["a"].p50 == 10.0 and got["a"].p25 == 5.0 and math.isclose(got["a"].p95, 19.0)
    assert got["b"].p95 == 20.0 and got["b"].p50 == 20.0
    assert "c" not in got


def test_gauge_lookback(spark):
    rows = [("used", 100 * 1000000, 3.0), ("used", 290 * 1000000, 5.0), ("idle", 10 * 1000000, 7.0)]
    df = spark.createDataFrame(rows, "state string, ts_us bigint, value double")
    got = {r.state: r.value for r in C.gauge_at(df, ["state"], 400 * 1000000).collect()}
    assert got == {"used": 5.0}           # idle's sample is older than the 5-minute lookback


def test_promql_duplicate_timestamps_do_not_divide_by_zero(spark):
    rows = [("a", 10 * 1000000, 1.0), ("a", 10 * 1000000, 1.0)]
    df = spark.createDataFrame(rows, "s string, ts_us bigint, value double")
    d = C.counter_deltas(df, ["s"])
    assert C.rate_series(d, ["s"], 0, 60 * 1000000, 30 * 1000000, 60 * 1000000, "promql").count() == 0


def test_histogram_uses_previous_bound_for_empty_low_buckets(spark):
    from telespark.sources.views import BUCKET_BOUNDS_MS
    obs = spark.createDataFrame([("a", 250.0, 10)], "g string, le double, n bigint")   # all in (100, 250]
    sparse = C.histogram_quantile(C.cumulative_buckets(obs, ["g"]), ["g"], {"p50": 0.5}).first().p50
    dense = C.histogram_quantile(C.cumulative_buckets(obs, ["g"], bounds=BUCKET_BOUNDS_MS), ["g"],
                                 {"p50": 0.5}).first().p50
    assert sparse == 125.0            # without the empty buckets the lower edge would be 0
    assert dense == 175.0             # the store's view: lower edge is the previous bound, 100
