"""Steps that are stored once: documents, sampled spans, rounds of the tree walks."""

from pyspark.sql import functions as F

from telespark import session
from telespark.operators import spans as S
from telespark.plans import traces as T
from telespark.sources import traces_json as J

SCHEMA = "trace_id long, span_id long, parent_span_id long, service string, start_us long, duration_us long, status int"


def _rows(traces, n=7):
    """Binary trees of n spans; the root is span 1."""
    return [(t, i, i // 2 or None, "gateway" if i == 1 else "orders", 1000 * t + i, 5, 200)
            for t in range(traces) for i in range(1, n + 1)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_documents_are_parsed_once(spark):
    df = spark.createDataFrame(_rows(3), SCHEMA)
    out = J.decode_traces(J.encode_traces(df))
    assert "from_json" not in _plan(out["spans"])
    assert {(r.trace_id, r.span_id, r.parent_span_id) for r in out["spans"].collect()} == {
        (str(t), str(s), str(p) if p else None) for t, s, p, *_ in _rows(3)}
    assert out["rejected"].count() == 0 and "spans" not in J.decode_traces(J.encode_traces(df), spans=False)


def test_last_tag_of_a_key_wins(spark):
    tags = [("error", "a"), ("db.statement", "x"), ("error", "b"), ("other", "c"), (None, "d"), ("error", None)]
    df = spark.createDataFrame([(1, tags), (2, None), (3, [])], "i int, tags array<struct<key:string,value:string>>")
    got = {r.i: r.m for r in df.select("i", J._last_wins_map(F.col("tags")).alias("m")).collect()}
    assert got == {1: {"db.statement": "x", "error": None}, 2: {}, 3: {}}


def test_only_sampled_spans_are_read_on(spark):
    df = spark.createDataFrame(_rows(30), SCHEMA)
    picked, sampled = S.sampled_spans(df, 0, 30_000, 6, "gateway")
    assert {r.trace_id for r in picked.collect()} == {8, 9, 18, 19, 28, 29}
    assert sampled.count() == 6 * 7 and "ExistingRDD" not in _plan(sampled) and "Exchange" not in _plan(sampled)


def test_partitions_follow_the_rows(spark):
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    with session.tasks_for(spark, 10_000_000):
        assert spark.conf.get(key) == "21"
    with session.tasks_for(spark, 10):
        assert spark.conf.get(key) == before
    assert spark.conf.get(key) == before


def test_reached_spans_are_not_walked_again(spark, monkeypatch):
    sizes = []

    def stored(df):
        out = session.stored(df)
        if "path" in df.columns or "position" in df.columns:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(T, "stored", stored)
    df = spark.createDataFrame(_rows(10), SCHEMA)
    assert T.trace_tree(df).count() == 70 and sizes == [70, 60, 40]
    sizes.clear()
    assert T.trace_preorder(df).count() == 70 and sizes == [70, 60, 40]
