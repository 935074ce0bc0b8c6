"""Load-generator statistics: trailing percentiles over the last N observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import TRAILING_OBSERVATIONS
from ..operators.joins import nearest_rows
from ..operators.quantiles import exact_percentiles

HOUR_US = 3600 * 1000000


def trailing_percentiles(requests: DataFrame, instants, n: int = TRAILING_OBSERVATIONS,
                         fractions=None, method: str = "nearest") -> DataFrame:
    """p50/p95/p99 over the last `n` requests (by ts, then request_id) at each instant.

    No window over the raw rows: see `nearest_rows` (hourly histogram -> bounded
    look-back per instant -> top n per instant).
    """
    fractions = fractions or {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    spark = requests.sparkSession
    if isinstance(instants, DataFrame):
        inst = instants.select(F.col("at_us").cast("bigint"))
    else:
        inst = spark.createDataFrame([(int(t),) for t in instants],
                                     T.StructType([T.StructField("at_us", T.LongType(), False)]))
    last = nearest_rows(requests, inst, n, "before")
    return exact_percentiles(last, ["at_us"], "duration_ms", fractions, method, passes=1)
