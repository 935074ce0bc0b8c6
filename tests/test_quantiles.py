import math
import random

import numpy as np
import pytest

from telespark.operators import quantiles
from telespark.operators.quantiles import exact_percentiles

FR = {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p0": 0.0, "p100": 1.0}


def nearest(values, f):
    s = sorted(values)
    return s[min(len(s) - 1, int(len(s) * f))]


@pytest.mark.parametrize("method,passes", [("linear", 2), ("nearest", 2), ("linear", 1), ("nearest", 1)])
def test_against_definitions(spark, method, passes):
    rng = random.Random(3)
    rows = []
    groups = {}
    for g in range(5):
        n = rng.choice([1, 2, 3, 10, 57, 400])
        vals = [rng.choice([rng.uniform(-50, 500), 0.0, 12.5, 1e-9, 3e6]) for _ in range(n)]
        groups[g] = vals
        rows += [(g, v) for v in vals]
    rows += [(9, None), (9, float("nan"))]            # ignored -> no row for group 9
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r.g: r for r in exact_percentiles(df, ["g"], "v", FR, method, count_col="n", passes=passes).collect()}
    assert set(got) == set(groups)
    for g, vals in groups.items():
        assert got[g].n == len(vals)
        for name, f in FR.items():
            want = float(np.percentile(vals, f * 100)) if method == "linear" else nearest(vals, f)
            assert math.isclose(getattr(got[g], name), want, rel_tol=1e-12, abs_tol=1e-12), (g, name)


def test_global_group(spark):
    vals = [float(i % 17) for i in range(1000)]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    r = exact_percentiles(df, [], "v", {"p95": 0.95}).collect()[0]
    assert r.p95 == float(np.percentile(vals, 95))


@pytest.mark.parametrize("passes", [1, 2])
@pytest.mark.parametrize("method", ["linear", "nearest"])
def test_one_service_with_all_rows(spark, monkeypatch, method, passes):
    """Continuous values, a narrow cluster, a value on a third of the rows: no leaf holds more
    than `leaf_rows` values unless they are equal."""
    rng = np.random.default_rng(11)
    values = np.concatenate([rng.uniform(100, 101, 12_000), 200 + rng.uniform(0, 1e-9, 6_000), np.full(9_000, 50.0),
                             -rng.uniform(0, 1e-300, 500), np.zeros(100)])
    df = spark.createDataFrame([("a", float(v)) for v in values], "g string, v double").repartition(4)
    seen = []
    real = quantiles.refine
    monkeypatch.setattr(quantiles, "refine", lambda *a: seen.append(real(*a)) or seen[-1])
    fractions = {"p01": 0.01, "p20": 0.2, "p50": 0.5, "p777": 0.777, "p95": 0.95, "max": 1.0}
    got = quantiles.exact_percentiles(df, ["g"], "v", fractions, method, "n", passes, leaf_rows=50).first()
    assert got.n == len(values)
    ordered = np.sort(values)
    for name, f in fractions.items():
        if method == "linear":
            assert got[name] == pytest.approx(np.quantile(values, f), rel=1e-15)
        else:
            assert got[name] == ordered[min(len(values) - 1, int(np.floor(len(values) * f)))]
    leaves = seen[0].collect()
    assert leaves and all(r._bc <= 50 or r._lo == r._hi for r in leaves)
