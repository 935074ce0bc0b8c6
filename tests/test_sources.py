import os

from pyspark.sql import functions as F

from telespark.sources.labels import failure_share, read_incidents, write_incidents
from telespark.sources.samples import read_samples, read_table, write_partitioned
from telespark.sources.traces_json import read_traces
from telespark.operators import spans as S

FIX = os.path.join(os.path.dirname(__file__), "fixtures")


def test_read_incidents(spark):
    df = read_incidents(spark, os.path.join(FIX, "labels.jsonl"))
    every = df.collect()
    rows = {r.incident_id: r for r in every if r._corrupt_record is None}
    assert set(rows) == {"run-a/i1", "run-a/i2", "run-b/i3"}              # blank line skipped
    assert sum(1 for r in every if r._corrupt_record is not None) == 1     # malformed line kept aside
    assert rows["run-a/i1"].confirmed_start_us == rows["run-a/i1"].start_us + 10000
    assert rows["run-a/i2"].params.pct == 20 and rows["run-a/i2"].params.ms is None
    assert rows["run-b/i3"].start_us is None                               # no zone -> rejected
    assert read_incidents(spark, os.path.join(FIX, "labels.jsonl"), run="run-a").count() == 2
    shares = {r.incident_id: r.failed_pct for r in failure_share(df).collect()}
    assert shares["run-a/i2"] == 20.0 and shares["run-b/i3"] is None


def test_write_incidents_round_trip(spark, tmp_path):
    df = read_incidents(spark, os.path.join(FIX, "labels.jsonl"), run="run-a")
    out = str(tmp_path / "labels")
    write_incidents(df.withColumn("_start_epoch", F.lit(1.0)), out)
    back = read_incidents(spark, out)
    got = back.select("incident_id", "_corrupt_record").collect()
    assert len(got) == 2 and "_start_epoch" not in back.columns
    assert all(r._corrupt_record is None for r in got)


def test_read_traces(spark):
    spans = {r.span_id: r for r in read_traces(spark, os.path.join(FIX, "trace_doc.json")).collect()}
    assert spans["s1"].parent_span_id is None and spans["s2"].parent_span_id == "s1"
    assert spans["s3"].service == "?" and spans["s3"].parent_span_id == "s2"
    assert "thread.id" not in spans["s1"].tags and spans["s1"].route == "/api/orders"
    assert spans["s2"].status == 502                      # repeated key: last wins
    assert spans["s2"].error is False and spans["s3"].error is True
    folded = S.fold_traces(S.self_time(read_traces(spark, os.path.join(FIX, "trace_doc.json")))).first()
    assert folded.root_span_id == "s1" and folded.errors == 2
    assert folded.self_us_by_service == "?=100;gateway=200;orders=200"


def test_read_samples(spark):
    rows = read_samples(spark, os.path.join(FIX, "matrix.json")).orderBy("series", "ts_us").collect()
    got = [(r.series, r.ts_us, r.value) for r in rows]
    assert got == [("all", 1754769451000000, 1.0), ("orders", 1754769451850000, 0.5),
                   ("orders", 1754769466850000, None), ("used", 1754769451000000, 3.0)]


def test_partitioned_read_prunes(spark, tmp_path):
    df = spark.createDataFrame([(i * 3600 * 1000000 * 7, i) for i in range(20)], "ts_us bigint, v int")
    path = str(tmp_path / "samples")
    write_partitioned(df, path)
    sel = read_table(spark, path, 24 * 3600 * 1000000, 3 * 24 * 3600 * 1000000)
    plan = sel._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan or "dt#" in plan
    assert sorted(r.v for r in sel.collect()) == [4, 5, 6, 7, 8, 9, 10]


def test_tree_lines_from_documents(spark):
    from telespark.plans.traces import render_tree_lines, trace_tree
    spans = read_traces(spark, os.path.join(FIX, "trace_doc.json"))
    lines = [r.line for r in render_tree_lines(trace_tree(spans)).orderBy("path").collect()]
    assert lines[0].startswith("gateway/POST /api/orders +0ms dur=0.5ms")
    assert lines[1].startswith("  orders/POST /orders +0ms") and "status=502" in lines[1]
    assert "error=" not in lines[1]                          # error=false is not shown
    assert lines[2].startswith("    ?/SELECT") and "db.statement=select 1" in lines[2] and "error=true" in lines[2]


def test_decode_traces_quarantine(spark):
    """Every text is decoded or rejected; names with quotes survive."""
    from telespark.sources.traces_json import decode_traces, encode_traces
    spans = spark.createDataFrame([(1, 1, None, 'gate"way', 10, 5, 200), (1, 2, 1, "orders", 11, 2, None)],
                                  "trace_id long, span_id long, parent_span_id long, service string, start_us long, "
                                  "duration_us long, status int")
    good = encode_traces(spans).first().value
    texts = [good, good[:-3], "", None, "[1, 2]", "{}", '{"data": null}', '{"data": []}', '{"data": [{"traceID": "9", "spans": 3}]}']
    out = decode_traces(spark.createDataFrame([(t,) for t in texts], "value string"))
    got = sorted((r.span_id, r.service, r.parent_span_id, r.status) for r in out["spans"].collect())
    assert got == [("1", 'gate"way', None, 200), ("2", "orders", "1", None)]
    rejected = {r.text: r.reason for r in out["rejected"].collect()}
    assert rejected[good[:-3]] == rejected[""] == rejected[None] == "malformed"
    assert rejected["{}"] == rejected['{"data": null}'] == "no data"
    assert good not in rejected and '{"data": []}' not in rejected
    assert out["rejected"].count() >= 6
