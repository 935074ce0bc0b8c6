"""Row predicates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import APP_ROUTE_EXCLUSION, SERVICES


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def anchored_match(col, pattern: str) -> Column:
    """Full-string regex match (PromQL `=~` semantics); null input is no match."""
    return F.coalesce(_c(col), F.lit("")).rlike(f"^(?:{pattern})$")


def app_routes(route="route") -> Column:
    """True for application routes: not exactly /health and not /chaos*.

    A missing route label passes, like an absent label under `!~`.
    """
    return ~anchored_match(route, APP_ROUTE_EXCLUSION)


def is_5xx(status="status") -> Column:
    """`status =~ "5.."` on an integer status column (pushable range predicate)."""
    return _c(status).between(500, 599)


def is_error_span(error="error", status="status") -> Column:
    """A span is an error when its error tag is truthy or its int status is >= 500."""
    return F.coalesce(_c(error), F.lit(False)) | F.coalesce(_c(status) >= 500, F.lit(False))


def is_ok(status="status") -> Column:
    """Client-side success: an integer status in [200, 400); anything else failed."""
    code = F.expr(f"try_cast({status} AS INT)") if isinstance(status, str) else status.try_cast("int")
    return F.coalesce((code >= 200) & (code < 400), F.lit(False))


def full_fidelity(scale="scale") -> Column:
    """Only unscaled runs contribute shared labels."""
    return F.abs(_c(scale) - F.lit(1.0)) < F.lit(1e-9)


def is_hex(col) -> Column:
    return F.coalesce(_c(col).rlike("^[0-9a-fA-F]+$"), F.lit(False))


def service_selector(df: DataFrame, service: str = "all", col: str = "service",
                     known=SERVICES) -> DataFrame:
    """`all` keeps every row; a known service filters; anything else is an error."""
    if service == "all":
        return df
    if service not in known:
        raise ValueError(f"unknown service {service!r}; known: {list(known) + ['all']}")
    return df.filter(F.col(col) == F.lit(service))


def label_eq(df: DataFrame, **labels) -> DataFrame:
    """Equality filter on label columns (pool name, state, ...)."""
    for key, value in labels.items():
        df = df.filter(F.col(key) == F.lit(value))
    return df


def in_window(df: DataFrame, start_us: int, end_us: int, ts: str = "ts_us") -> DataFrame:
    """Absolute window, inclusive at both ends (a plain range predicate, pushed to
    the parquet scan when `ts` is a stored column)."""
    return df.where(F.col(ts).between(F.lit(start_us), F.lit(end_us)))


def retain(df: DataFrame, as_of_us: int, retention_hours: float, ts: str = "ts_us") -> DataFrame:
    """Rows inside the store's retention horizon [as_of - retention, as_of]."""
    return in_window(df, as_of_us - int(retention_hours * 3600 * 1_000_000), as_of_us, ts)
