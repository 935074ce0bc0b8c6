"""Small scalar helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DETAIL_TEXT_MAX, FAULT_METRIC


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def id_suffix(col) -> Column:
    """'run-x/i2' -> 'i2' (text after the last slash)."""
    return F.substring_index(_c(col), "/", -1)


def truncate_text(col, n: int = DETAIL_TEXT_MAX) -> Column:
    return F.left(_c(col).cast("string"), F.lit(n))


def fault_metric(col) -> Column:
    """Fault type -> metric that should move; unknown faults map to latency."""
    expr = None
    for fault, metric in FAULT_METRIC.items():
        expr = (F.when(_c(col) == fault, metric) if expr is None
                else expr.when(_c(col) == fault, metric))
    return expr.otherwise("latency")


def nan_to_null(col) -> Column:
    """NaN -> null (Spark orders NaN above every number, so max/percentile would pick it)."""
    c = _c(col)
    return F.when(~F.isnan(c), c)


def expected_signal(checks_col) -> Column:
    """Names of the checks whose expectation is not 'flat'."""
    return F.transform(F.filter(_c(checks_col), lambda c: c["expect"] != "flat"),
                       lambda c: c["name"])


def format_value(col, digits: int = 3) -> Column:
    """Fixed decimals, 'n/a' for null (report rendering)."""
    return F.coalesce(F.when(_c(col).isNotNull(), F.format_string(f"%.{digits}f", _c(col).cast("double"))), F.lit("n/a"))


def round_half_even(col, digits: int = 1) -> Column:
    """Presentation rounding, half to even (Python's `round`); NaN -> null.
    Aggregations keep integer microseconds and round only at the end."""
    c = _c(col)
    return F.when(~F.isnan(c), F.bround(c, digits))
