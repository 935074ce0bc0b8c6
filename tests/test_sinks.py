import pytest
from pyspark.sql import functions as F

from telespark.sources.sinks import EvidenceExists, existing_incidents, export_traces, merge_index

SCHEMA = ("trace_id bigint, span_id bigint, parent_span_id bigint, service string, "
          "start_us bigint, duration_us bigint, status int")


def _spans(spark, traces):
    rows = []
    for t, start in traces:
        rows += [(t, 1, None, "gateway", start, 100, 200), (t, 2, 1, "inventory", start + 10, 50, 200)]
    return spark.createDataFrame(rows, SCHEMA)


def test_export_refuses_then_force_keeps_untouched(spark, tmp_path):
    path = str(tmp_path / "evidence")
    inc = spark.createDataFrame([("r/i1", "inventory", "latency", 0, 1000), ("r/i2", "orders", "error_rate", 5000, 6000)],
                                "incident_id string, service string, fault_type string, start_us bigint, end_us bigint")
    idx = export_traces(_spans(spark, [(1, 100), (2, 200), (3, 5500)]), inc, path, "r").collect()
    assert {(r.incident_id, r.traces, r.spans) for r in idx} == {("r/i1", 2, 4), ("r/i2", 1, 2)}
    assert existing_incidents(spark, path, "r") == ["r/i1", "r/i2"]
    with pytest.raises(EvidenceExists):
        export_traces(_spans(spark, [(9, 100)]), inc, path, "r")
    # forced re-export: i1 has new traces, i2 has none -> i2's earlier export stays
    export_traces(_spans(spark, [(9, 100)]), inc, path, "r", force=True)
    back = spark.read.parquet(path)
    got = {(r.incident_id, r.trace_id) for r in back.select("incident_id", "trace_id").distinct().collect()}
    assert got == {("r/i1", 9), ("r/i2", 3)}


def test_merge_index(spark):
    cols = "incident_id string, file string, traces int"
    old = spark.createDataFrame([("r/i1", "i1.json", 15), ("r/i2", "i2.json", 15), ("r/i9", "i9.json", 3)], cols)
    new = spark.createDataFrame([("r/i2", "i2.json", 12), ("r/i3", "i3.json", 14)], cols)
    files = spark.createDataFrame([("i1.json",), ("i2.json",), ("i3.json",)], "file string")
    labels = spark.createDataFrame([("r/i1", 0), ("r/i2", 1), ("r/i3", 2)], "incident_id string, pos int")
    got = [(r.incident_id, r.traces) for r in merge_index(old, new, files, labels).collect()]
    assert got == [("r/i1", 15), ("r/i2", 12), ("r/i3", 14)]          # i9's file is gone
    files2 = files.union(spark.createDataFrame([("i9.json",)], "file string"))
    got2 = [r.incident_id for r in merge_index(old, new, files2, labels).collect()]
    assert got2[-1] == "r/i9"                                          # unknown incidents last


def test_evidence_index_round_trip(spark, tmp_path):
    import os
    from telespark.sources.sinks import read_evidence_index, write_evidence_index
    fix = os.path.join(os.path.dirname(__file__), "fixtures", "index.json")
    idx = read_evidence_index(spark, fix)
    rows = idx.orderBy("pos").collect()
    assert [(r.incident_id, r.traces, r.spans) for r in rows] == [
        ("run-x/i1", 15, 111), ("run-x/i2", 15, 82), ("run-x/i3", 15, 105), ("run-x/i4", 15, 111)]
    assert rows[0].window_end_us - rows[0].window_start_us == 240 * 1000000
    out = str(tmp_path / "index")
    write_evidence_index(idx, out, "run-x", 15)
    back = read_evidence_index(spark, out + "/*.json").orderBy("pos").collect()
    assert [(r.incident_id, r.window_start_us, r.spans) for r in back] == \
        [(r.incident_id, r.window_start_us, r.spans) for r in rows]


def test_failure_share_matches_recorded_labels(spark, tmp_path):
    import json
    from telespark.sources.labels import failure_share, read_incidents
    recorded = [("run-a/i2", 1424, 285), ("run-b/i2", 1421, 262), ("run-c/i2", 1421, 272)]
    path = tmp_path / "labels.jsonl"
    path.write_text("\n".join(json.dumps({"schema": 1, "run_id": i.split("/")[0], "incident_id": i,
                                          "fault_type": "error_rate", "service": "orders",
                                          "observed": {"requests_seen": s, "requests_failed": f}})
                              for i, s, f in recorded) + "\n")
    got = {r.incident_id: round(r.failed_pct, 2)
           for r in failure_share(read_incidents(spark, str(path))).select("incident_id", "failed_pct").collect()}
    assert got == {"run-a/i2": 20.01, "run-b/i2": 18.44, "run-c/i2": 19.14}


def test_publish_all_or_nothing(spark, tmp_path, monkeypatch):
    """A failed job and a failed move leave the old partitions, and nothing half-written."""
    import os

    import pytest
    from pyspark.sql import functions as F

    from telespark.sources import sinks
    path = str(tmp_path / "out")

    def rows(version, n=3):
        return spark.createDataFrame([("r/1", f"i {k}", version) for k in range(n)], "run string, inc string, v int")

    def state():
        df = spark.read.parquet(path)
        return {(r.run, r.inc): r.v for r in df.collect()}, sorted(x for x in os.listdir(path) if x.startswith("."))
    assert len(sinks.publish_partitions(rows(1), path, ["run", "inc"])) == 3
    first = state()
    assert first == ({("r/1", f"i {k}"): 1 for k in range(3)}, [])
    bad = rows(2).withColumn("v", F.when(F.col("inc") == "i 2", F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        sinks.publish_partitions(bad, path, ["run", "inc"])
    assert state() == first
    real, calls = sinks._rename, []

    def failing(fs, source, target):
        calls.append(1)
        if len(calls) == 4:
            raise IOError("no move")
        real(fs, source, target)
    monkeypatch.setattr(sinks, "_rename", failing)
    with pytest.raises(IOError, match="no move"):
        sinks.publish_partitions(rows(3), path, ["run", "inc"])
    assert state() == first
    monkeypatch.setattr(sinks, "_rename", real)
    sinks.publish_partitions(rows(4, 2), path, ["run", "inc"])
    assert state()[0] == {("r/1", "i 0"): 4, ("r/1", "i 1"): 4, ("r/1", "i 2"): 1}
