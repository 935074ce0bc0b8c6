import os

from pyspark.sql import functions as F

from telespark.sources import views as V
from telespark.streaming.red import (late_account, red_rollup, red_rollup_stream, repair_rollup, silent_services_stream,
                                     silent_stretches, with_event_time)

SF = "/root/testdata/sf0.001"


def _write_chunks(spark, df, folder, n=4):
    """Split a batch into n files by time so a file stream replays them in order."""
    lo, hi = df.agg(F.min("ts_us"), F.max("ts_us")).first()
    width = (hi - lo) // n + 1
    for i in range(n):
        part = df.where((F.col("ts_us") >= lo + i * width) & (F.col("ts_us") < lo + (i + 1) * width))
        part.coalesce(1).write.mode("overwrite").parquet(os.path.join(folder, f"part{i}"))


def test_stream_equals_batch(spark, tmp_path):
    req = V.requests(spark, SF)
    src = str(tmp_path / "src")
    _write_chunks(spark, req, src)
    batch = red_rollup(with_event_time(req), "1 hour")
    stream = (spark.readStream.schema(req.schema).option("maxFilesPerTrigger", 1)
              .parquet(os.path.join(src, "part*")))
    out = red_rollup_stream(stream, "1 hour", watermark="0 seconds")
    q = (out.writeStream.format("memory").queryName("red_stream").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = spark.table("red_stream")
    # every window the watermark has closed must equal the batch recompute
    closed = got.agg(F.max("window_end_us")).first()[0]
    b = batch.where(F.col("window_end_us") <= closed)
    assert got.count() > 0
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, b.collect()))
    progress = q.lastProgress or {}
    assert progress.get("numInputRows", 0) >= 0


def test_silent_services(spark, tmp_path):
    rows = [(1, 1_000_000, "gateway", "/a", 200, 1.0), (2, 60_000_000, "orders", "/a", 200, 1.0),
            (3, 400_000_000, "orders", "/a", 200, 1.0), (4, 900_000_000, "orders", "/a", 200, 1.0)]
    schema = "request_id bigint, ts_us bigint, service string, route string, status int, duration_ms double"
    df = spark.createDataFrame(rows, schema)
    src = str(tmp_path / "ev")
    for i, r in enumerate(rows):
        spark.createDataFrame([r], schema).write.parquet(os.path.join(src, f"f{i}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(src, "f*"))
    q = (silent_services_stream(stream, watermark="0 seconds").writeStream.format("memory")
         .queryName("silent").outputMode("append").option("checkpointLocation", str(tmp_path / "c2"))
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = {(r.service, r.last_seen_us) for r in spark.table("silent").collect()}
    # gateway went quiet after t=1s (timeout once the watermark passed 301 s); orders
    # after t=60s (the 340 s gap exceeds 5 minutes); orders after 900 s is not yet due
    assert got == {("gateway", 1_000_000), ("orders", 60_000_000), ("orders", 400_000_000)}


def test_parquet_job_restarts_from_checkpoint(spark, tmp_path):
    from telespark.streaming.red import start_red_rollup
    req = V.requests(spark, SF)
    src = str(tmp_path / "in")
    _write_chunks(spark, req, src, n=2)
    sink, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    # first run sees only part0; the second run resumes and picks up part1
    first = tmp_path / "in_first"
    first.mkdir()
    import shutil
    shutil.copytree(os.path.join(src, "part0"), str(first / "part0"))
    q = start_red_rollup(spark, str(first / "*"), sink, ck, req.schema, "1 hour", "0 seconds",
                         {"availableNow": True})
    q.awaitTermination(300)
    n1 = spark.read.parquet(sink).count()
    shutil.copytree(os.path.join(src, "part1"), str(first / "part1"))
    q = start_red_rollup(spark, str(first / "*"), sink, ck, req.schema, "1 hour", "0 seconds",
                         {"availableNow": True})
    q.awaitTermination(300)
    got = spark.read.parquet(sink)
    assert got.count() > n1
    # nothing is emitted twice and every emitted window equals the batch recompute
    assert got.count() == got.select("window_start_us", "service").distinct().count()
    batch = red_rollup(with_event_time(req), "1 hour")
    closed = got.agg(F.max("window_end_us")).first()[0]
    want = batch.where(F.col("window_end_us") <= closed)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_sliding_stream_equals_batch(spark, tmp_path):
    from telespark.streaming.red import sliding_panels_stream
    req = V.requests(spark, SF)
    src = str(tmp_path / "src")
    _write_chunks(spark, req, src, n=3)
    stream = (spark.readStream.schema(req.schema).option("maxFilesPerTrigger", 1)
              .parquet(os.path.join(src, "part*")))
    out = sliding_panels_stream(stream, "2 hours", "1 hour", watermark="0 seconds")
    q = (out.writeStream.format("memory").queryName("sliding").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = spark.table("sliding")
    closed = got.agg(F.max("window_end_us")).first()[0]
    want = red_rollup(with_event_time(req), "2 hours", "1 hour").where(F.col("window_end_us") <= closed)
    assert got.count() > 0
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    """Spark judges lateness against the previous micro-batch's watermark: a late
    row in the batch right after the watermark moved is still aggregated, the same
    row one batch later is dropped and counted (numRowsDroppedByWatermark)."""
    import time
    schema = "request_id bigint, ts_us bigint, service string, route string, status int, duration_ms double"
    src = str(tmp_path / "late")
    on_time = [(i, (3600 + i * 60) * 1000000, "orders", "/orders", 200, 10.0) for i in range(30)]
    late1 = [(998, 60 * 1000000, "orders", "/orders", 500, 10.0)]
    late2 = [(999, 120 * 1000000, "orders", "/orders", 503, 10.0)]
    for name, rows in (("a", on_time), ("b", late1), ("c", late2)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(src, name))
        time.sleep(1.1)                                   # distinct modification times: file order
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(src, "*"))
    q = (red_rollup_stream(stream, "15 minutes", watermark="1 minute").writeStream.format("memory")
         .queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "ck"))
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    dropped = sum(op.get("numRowsDroppedByWatermark", 0)
                  for p in q.recentProgress for op in p.get("stateOperators", []))
    assert dropped == 1
    early = spark.table("late").where(F.col("window_start_us") == 0).first()
    assert early.requests == 1 and early.errors_5xx == 1            # late1 kept, late2 dropped
    account = {r.batch_id: r.dropped_rows for r in late_account(q).collect()}
    assert sum(account.values()) == 1
    # the batch run over every row that arrived puts it right
    fixed = repair_rollup(spark.table("late"), spark.read.schema(schema).parquet(os.path.join(src, "*")), "15 minutes")
    by = {(r.window_start_us, r.repaired): (r.requests, r.errors_5xx) for r in fixed.collect()}
    assert by[0, True] == (2, 2)
    emitted = {r.window_start_us: (r.requests, r.errors_5xx) for r in spark.table("late").collect()}
    assert {k: v for (k, repaired), v in by.items() if not repaired} == {k: v for k, v in emitted.items() if k}


def test_silence_ties_and_batch_twin(spark, tmp_path):
    """Exactly five minutes is no silence, a microsecond more is; stream and batch agree."""
    s = 300 * 1000000
    times = {"a": [0, s, 2 * s + 1, 5 * s], "b": [10, 11, 12, 12 + s, 20 * s], "c": [7, 50 * s], "d": [30 * s]}
    rows = [(t, svc) for svc, ts in times.items() for t in ts] + [(5, None)]
    want = {(svc, t) for svc, ts in times.items() for t, u in zip(ts, ts[1:] + [40 * s]) if u - t > s and t < 40 * s}
    df = spark.createDataFrame(rows, "ts_us long, service string")
    got = silent_stretches(df, 40 * s)
    assert {(r.service, r.last_seen_us) for r in got.collect()} == want == {
        (r.service, r.last_seen_us) for r in silent_stretches(df, 40 * s, silence_us=s).collect()}
    assert all(r.silent_after_us == r.last_seen_us + s for r in got.collect())
    # in time order, in one file per row; the last row moves the watermark on
    src = str(tmp_path / "ev")
    for i, r in enumerate(sorted(rows, key=lambda r: r[0])):
        spark.createDataFrame([r], df.schema).write.parquet(os.path.join(src, f"f{i:02d}"))
        os.utime(os.path.join(src, f"f{i:02d}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(src, "f*"))
    out = silent_services_stream(stream, watermark="0 seconds")
    assert "Python" not in out._jdf.queryExecution().toString()
    q = (out.writeStream.format("memory").queryName("ties").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    streamed = {(r.service, r.last_seen_us) for r in spark.table("ties").collect()}
    assert streamed == {(r.service, r.last_seen_us) for r in silent_stretches(df, 50 * s).collect()}
    assert silent_stretches(df.limit(0), s).count() == 0
