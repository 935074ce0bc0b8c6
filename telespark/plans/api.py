"""User-facing entry points with the reference tools' argument shapes.

    store = TelemetryStore(requests=..., spans=..., gauges=..., as_of_us=...)
    store.query_metrics("latency", service="all", window="15m", percentile=95)
    store.query_traces("gateway", start="2026-08-09T20:17:31Z", end="...", limit=20)
    store.get_trace("abc123")
    store.telemetry_status()

Each call resolves its window on the driver (strict ISO with zone, retention
clamping with notes) and returns DataFrames plus a small dict of scalars; nothing
is collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_TRACES, METRICS_RETENTION_HOURS, TRACES_RETENTION_HOURS
from ..operators import spans as S
from . import metrics as M
from . import status as ST
from . import traces as T
from .window import resolve_trace_window, resolve_window


@dataclass
class TelemetryStore:
    requests: DataFrame | None = None
    spans: DataFrame | None = None
    gauges: DataFrame | None = None
    as_of_us: int | None = None
    metrics_retention_hours: float = METRICS_RETENTION_HOURS
    traces_retention_hours: float = TRACES_RETENTION_HOURS

    def query_metrics(self, metric: str, service: str = "all", window: str | None = None,
                      start: str | None = None, end: str | None = None, percentile: int = 95) -> dict:
        M.validate(metric, service, percentile)
        win = resolve_window(window, start, end, as_of_us=self.as_of_us,
                             retention_hours=self.metrics_retention_hours)
        out = M.query_metrics(self.requests, metric, win, self.as_of_us, service, percentile,
                              self.gauges, self.metrics_retention_hours)
        out.update({"window": win.payload(), "step_s": win.step_s(), "notes": list(win.notes)})
        return out

    def query_traces(self, service: str, window: str | None = None, start: str | None = None,
                     end: str | None = None, limit: int = DEFAULT_TRACES, min_duration_ms=None,
                     errors_only: bool = False, membership: str = "root") -> dict:
        win = resolve_trace_window(window=window, start=start, end=end, as_of_us=self.as_of_us,
                                   retention_hours=self.traces_retention_hours)
        out = T.query_traces(self.spans, service, win.start_us, win.end_us, limit, min_duration_ms,
                             errors_only, membership)
        out.update({"window": win.payload(), "notes": list(win.notes)})
        return out

    def get_trace(self, trace_id: str, cap: int | None = None) -> dict:
        """One trace as preorder rows and rendered lines. With `cap`, the tree lists only the
        earliest `cap` spans (by start, id); self time is that of the whole trace.
        `truncated`: whether there were more. An id that is not hex is an argument error;
        an unknown id gives an empty tree."""
        tid = (trace_id or "").strip()
        if not tid or not all(c in "0123456789abcdefABCDEF" for c in tid):
            raise ValueError(f"trace_id must be hexadecimal, got {trace_id!r}")
        one = self.spans.where(F.col("trace_id").cast("string") == F.lit(tid))
        tree = T.render_tree_lines(T.trace_tree(one))
        if cap is None:
            truncated = one.select("trace_id", F.lit(False).alias("truncated")).distinct()
        else:
            listed = S.cap_spans(one.select("trace_id", "span_id", "start_us"), cap)
            truncated = listed.select("trace_id", "truncated").distinct()
            tree = tree.join(listed.select("trace_id", "span_id"), ["trace_id", "span_id"], "left_semi")
        return {"tree": tree.orderBy("path"), "truncated": truncated}

    def telemetry_status(self, lookback_s: int = 300, traces: bool = False) -> DataFrame:
        """Coverage of the request table; with `traces`, of the span table too."""
        return ST.telemetry_status(self.requests, self.requests.sparkSession, self.as_of_us,
                                   self.metrics_retention_hours, lookback_s,
                                   spans=self.spans if traces else None,
                                   trace_retention_hours=self.traces_retention_hours)
