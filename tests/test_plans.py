"""Plan properties that the scale design relies on."""

import random
from contextlib import contextmanager

from pyspark.sql import functions as F

from telespark.operators import joins
from telespark.operators.joins import interval_join, nearest_rows
from telespark.operators.quantiles import exact_percentiles
from telespark.sources.samples import read_table, write_partitioned


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@contextmanager
def no_broadcast(spark):
    """As if the interval side were too large."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before, most = spark.conf.get(key), joins.BROADCAST_BYTES
    spark.conf.set(key, "-1")
    joins.BROADCAST_BYTES = -1
    try:
        yield
    finally:
        spark.conf.set(key, before)
        joins.BROADCAST_BYTES = most


def _rows_and_windows(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([(i, rng.randint(0, 10_000), rng.choice("ab")) for i in range(3000)],
                                 "id bigint, ts_us bigint, k string")
    wins = spark.createDataFrame([(f"w{j}", s, s + rng.randint(0, 900), rng.choice("ab"))
                                  for j, s in enumerate(rng.sample(range(0, 10_000), 40))],
                                 "wid string, w_start bigint, w_end bigint, k string")
    return rows, wins


def test_interval_join_shuffle_path_equals_broadcast_path(spark):
    rows, wins = _rows_and_windows(spark)
    b = interval_join(rows, wins, "ts_us", "w_start", "w_end", bucket_us=500, on=["k"])
    assert "BroadcastHashJoin" in _plan(b)
    want = sorted((r.id, r.wid) for r in rows.join(wins, "k").where(
        F.col("ts_us").between(F.col("w_start"), F.col("w_end"))).collect())
    assert sorted((r.id, r.wid) for r in b.collect()) == want
    with no_broadcast(spark):
        s = interval_join(rows.withColumn("m", F.create_map(F.lit("a"), "id")), wins, "ts_us", "w_start", "w_end",
                          bucket_us=500, on=["k"])
        assert "BroadcastHashJoin" not in _plan(s) and "BroadcastNestedLoopJoin" not in _plan(s)
        assert sorted((r.id, r.wid) for r in s.collect()) == want
        left = interval_join(rows, wins, "ts_us", "w_start", "w_end", bucket_us=500, how="left", on=["k"])
        assert left.where(F.col("wid").isNull()).count() == rows.count() - len({i for i, _ in want})


def test_interval_join_of_one_hot_bucket(spark):
    """All rows and 5,000 intervals in one bucket, both sides shuffled; an empty interval."""
    rows = spark.range(20_000).select("id", (F.col("id") % 5000).alias("ts_us"))
    wins = spark.range(5000).select(F.col("id").alias("wid"), F.col("id").alias("w_start"), (F.col("id") + 1).alias("w_end"))
    wins = wins.unionByName(spark.createDataFrame([(-1, 10, 5)], wins.schema))
    with no_broadcast(spark):
        got = interval_join(rows, wins, "ts_us", "w_start", "w_end", bucket_us=86400 * 1000000)
        assert got.count() == 20_000 * 2 - 4 and got.where("wid < 0 OR ts_us NOT IN (w_start, w_end)").count() == 0


def test_nearest_rows_with_keys(spark):
    rows = spark.createDataFrame([(i, i * 10, "ab"[i % 2]) for i in range(100)], "request_id bigint, ts_us bigint, k string")
    anchors = spark.createDataFrame([(500, "a"), (500, "b")], "at_us bigint, k string")
    got = nearest_rows(rows, anchors, 3, "after", hist_us=50, on=["k"]).collect()
    assert sorted((r.k, r.rank, r.ts_us) for r in got) == [("a", 1, 520), ("a", 2, 540), ("a", 3, 560),
                                                            ("b", 1, 510), ("b", 2, 530), ("b", 3, 550)]


def test_percentiles_avoid_single_task_percentile(spark):
    df = spark.range(2000).select((F.col("id") % 7).alias("g"), (F.col("id") * 1.5).alias("v"))
    plan = _plan(exact_percentiles(df, ["g"], "v", {"p95": 0.95}))
    assert "percentile(" not in plan.lower()


def test_read_table_pushes_time_filters(spark, tmp_path):
    df = spark.range(48).select((F.col("id") * 3600 * 1000000).alias("ts_us"), F.col("id").alias("v"))
    path = str(tmp_path / "t")
    write_partitioned(df, path)
    sel = read_table(spark, path, 10 * 3600 * 1000000, 30 * 3600 * 1000000)
    plan = _plan(sel)
    assert "PartitionFilters: [isnotnull(dt" in plan and "PushedFilters: [IsNotNull(ts_us), GreaterThanOrEqual(ts_us" in plan
    assert sel.count() == 21
