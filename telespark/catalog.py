"""Registered queries over the driver's tables, each with its DuckDB oracle.

`queries()` maps a name to fn(spark, sf_dir) -> DataFrame; `oracle_sql()` maps the
same name to SQL over the pre-registered parquet views. Every query reads whole
tables (or views Spark derives from them); floating outputs are rounded to the same
digits on both sides, times are epoch microseconds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.oracle_views import with_views
from .sources import views as V
from .operators import spans as S

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLE[name] = sql
        return fn
    return deco


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_ORACLE)


def _load_all():
    # importing the modules registers their queries
    from . import (catalog_incidents, catalog_requests, catalog_series, catalog_sources, catalog_status,  # noqa: F401
                   catalog_traces)


def r6(col):
    return F.round(F.col(col) if isinstance(col, str) else col, 6)


# ---------------------------------------------------------------------------
# flagship: self-time by service (O-24, O-46, O-48)
# ---------------------------------------------------------------------------

@register("self_time_by_service", with_views("selfs") + """
SELECT service, CAST(sum(self_us) AS BIGINT) AS self_us, count(*) AS spans,
  round(100.0 * sum(self_us) / sum(sum(self_us)) OVER (), 6) AS pct
FROM selfs GROUP BY service""")
def q_self_time_by_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    selfs = S.self_time(V.spans_table(spark, sf_dir), resolve=False)
    out = S.self_time_by_service(selfs)
    return out.select("service", "self_us", "spans", r6("pct").alias("pct"))
