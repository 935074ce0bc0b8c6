import __spark_entry__ as E
from telespark import catalog


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["service", "self_us", "spans", "pct"]
    assert {r.service for r in rows} == {"gateway", "orders", "inventory"}
    assert abs(sum(r.pct for r in rows) - 100.0) < 1e-6


def test_every_query_has_an_oracle():
    qs, sql = catalog.queries(), catalog.oracle_sql()
    assert len(qs) >= 50
    assert set(sql) == set(qs)
    # the text operators may have none: what SQL cannot express is tested by brute force
    assert set(sql) <= set(E.oracle_sql()) <= set(E.queries())


def test_queries_run_on_smallest_fixture(spark):
    for name, fn in E.queries().items():
        df = fn(spark, "/root/testdata/sf0.001")
        assert len(df.columns) > 0, name
