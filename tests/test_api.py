import pytest

from telespark.plans.api import TelemetryStore
from telespark.plans.window import WindowError
from telespark.functions.time import parse_instant
from telespark.sources import views as V

SF = "/root/testdata/sf0.001"


def test_store_end_to_end(spark):
    as_of = parse_instant("2024-01-08T00:00:00Z")
    store = TelemetryStore(requests=V.requests_faulted(spark, SF), spans=V.spans(spark, SF),
                           gauges=V.pool_gauge(spark, SF), as_of_us=as_of,
                           metrics_retention_hours=24 * 30, traces_retention_hours=24 * 365 * 40)
    out = store.query_metrics("latency", window="3d")
    assert out["window"]["duration_s"] == 3 * 86400 and out["step_s"] == 21600
    assert out["series"].count() == 3 and out["status"].first().reason == "ok"
    pool = store.query_metrics("db_pool", service="inventory", start="2024-01-05T00:00:00Z",
                               end="2024-01-07T00:00:00Z")
    assert {r.service for r in pool["series"].collect()} == {"used", "idle"}
    with pytest.raises(WindowError):
        store.query_metrics("latency", start="2024-01-05T00:00:00")          # naive timestamp
    tr = store.query_traces("gateway", start="1995-01-01T00:00:00Z", end="2001-09-01T00:00:00Z", limit=9)
    assert tr["summary"].first().sampled == 9
    tid = str(tr["traces"].first().trace_id)
    one = store.get_trace(format(int(tid), "d"))
    rows = one["tree"].collect()
    assert rows and rows[0].depth == 0 and rows[0].line.startswith("gateway")
    with pytest.raises(ValueError):
        store.get_trace("not-hex!")
    assert store.get_trace("123456789")["tree"].count() == 0
    st = store.telemetry_status(lookback_s=86400).first()
    assert st.status == "ok"
