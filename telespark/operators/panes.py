"""Pane aggregation: sliding counts without a fan-out of rows.

A step series with range r and step s covers (t_k - r, t_k]. Every such range is a run
of whole panes, the right-closed intervals of width gcd(r, s) from the start, so rows are
counted once per pane (partial aggregation before the shuffle) and only the panes, whose
number depends on the time span and not on the rows, are sent to the r/s steps that hold
them. Several ranges over one table share the panes of their common divisor, and so one
scan. An odd range or step only makes the panes narrow: results stay the same.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .series import assign_steps


def pane_width(step_us: int, *ranges_us: int) -> int:
    """The widest pane of which the step and every range are multiples."""
    if min(step_us, *ranges_us) <= 0:
        raise ValueError(f"step and ranges must be positive, got {step_us} and {ranges_us}")
    return gcd(int(step_us), *(int(r) for r in ranges_us))


def pane_aggregate(df: DataFrame, keys, aggs: dict, start_us: int, end_us: int, width_us: int,
                   reach_us: int, ts: str = "ts_us") -> DataFrame:
    """keys..., pane_us, aggs...: one row per key and pane (pane_us - width, pane_us] of the
    rows in (start - reach, end]. `pane_us` is the pane's last instant; rows with a null
    instant belong to none."""
    rel = F.col(ts) - F.lit(start_us)
    pane = F.lit(start_us) + F.ceil(rel / F.lit(width_us)).cast("bigint") * F.lit(width_us)
    rows = df.where((F.col(ts) > start_us - reach_us) & (F.col(ts) <= end_us))
    return rows.groupBy(*keys, pane.alias("pane_us")).agg(*[a.alias(n) for n, a in aggs.items()])


def panes_to_steps(panes: DataFrame, keys, counts, start_us: int, end_us: int, step_us: int,
                   range_us: int) -> DataFrame:
    """keys..., step_us, counts...: the sums of `counts` over the panes of each step's range.

    A pane lies wholly inside or outside a range, so its last instant stands for its rows."""
    steps = assign_steps(panes, start_us, end_us, step_us, range_us, ts="pane_us")
    return steps.groupBy(*keys, "step_us").agg(*[F.sum(c).alias(c) for c in counts])


def step_counts(df: DataFrame, keys, aggs: dict, start_us: int, end_us: int, step_us: int,
                range_us: int, ts: str = "ts_us") -> DataFrame:
    """keys..., step_us and the counts `aggs` over (t - range, t] for the steps that hold rows.

    `aggs` are counts or sums by name (they add up over panes). With range == step a pane
    is a step's range and nothing is added up again."""
    width = pane_width(step_us, range_us)
    panes = pane_aggregate(df, keys, aggs, start_us, end_us, width, range_us, ts)
    if width == step_us == range_us:
        # the last pane may be cut by the end: its step lies beyond the window
        return panes.where(F.col("pane_us") <= end_us).withColumnRenamed("pane_us", "step_us")
    return panes_to_steps(panes, keys, list(aggs), start_us, end_us, step_us, range_us)


def ranged_counts(df: DataFrame, keys, aggs: dict, start_us: int, end_us: int, step_us: int,
                  ranges: dict, ts: str = "ts_us") -> DataFrame:
    """range_name, keys..., step_us, counts...: `step_counts` for several named ranges from
    one scan and one aggregation of the rows."""
    width = pane_width(step_us, *ranges.values())
    panes = pane_aggregate(df, keys, aggs, start_us, end_us, width, max(ranges.values()), ts)
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("range_name"), F.lit(int(r)).cast("bigint").alias("range_us"))
                                for n, r in ranges.items()]))
    spread = panes.withColumn("_r", named).select("*", "_r.range_name", "_r.range_us").drop("_r")
    steps = assign_steps(spread, start_us, end_us, step_us, F.col("range_us"), ts="pane_us")
    return steps.groupBy("range_name", *keys, "step_us").agg(*[F.sum(c).alias(c) for c in aggs])
