"""Interval (range) joins.

Rows are matched to [start, end] intervals (inclusive) through an equi-join on a
coarse time bucket: each interval is exploded into the buckets it overlaps (a
fan-out of length/bucket, bounded by the interval table, never by the data), each
row computes its single bucket, and the exact bound is rechecked after the join.
An interval side of at most BROADCAST_BYTES, measured by one aggregate, is
broadcast (Spark cannot tell the size of rows that come from the driver or a
checkpoint, and would shuffle the rows first); with a larger one both sides are
shuffled and adaptive execution splits the rows of a hot bucket over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


BROADCAST_BYTES = 32 * 1024 * 1024


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """`df` marked for broadcast if its rows, written out, have at most BROADCAST_BYTES."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def interval_join(rows: DataFrame, intervals: DataFrame, ts: str = "ts_us",
                  start: str = "start_us", end: str = "end_us",
                  bucket_us: int = 86400 * 1000000, how: str = "inner", on=()) -> DataFrame:
    """rows x intervals where intervals.start <= rows.ts <= intervals.end (and the
    `on` columns are equal; they appear once in the output).

    Other column names of the two sides must be disjoint: the caller renames
    first. `how` is 'inner' or 'left' (rows kept without a match). Columns of any
    type are carried, intervals that end before they start match nothing.
    """
    on = list(on)

    def bucket(c):
        return F.floor(F.col(c) / bucket_us).cast("bigint")

    iv = (intervals.where(F.col(start) <= F.col(end))
          .select(*[F.col(k).alias(f"_on_{k}") for k in on], *[c for c in intervals.columns if c not in on],
                  F.explode(F.sequence(bucket(start), bucket(end))).alias("_iv_bk")))
    cond = (F.col("_bk") == F.col("_iv_bk")) & F.col(ts).between(F.col(start), F.col(end))
    for k in on:
        cond = cond & (F.col(k) == F.col(f"_on_{k}"))
    out = rows.withColumn("_bk", bucket(ts)).join(broadcast_if_small(iv), cond, how)
    return out.drop("_bk", "_iv_bk", *[f"_on_{k}" for k in on])


def join_single_rows(*frames: DataFrame) -> DataFrame:
    """Side-by-side join of one-row aggregates (equi-join on a constant key)."""
    out = frames[0].withColumn("_one", F.lit(1))
    for f in frames[1:]:
        out = out.join(f.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")


def nearest_rows(rows: DataFrame, anchors: DataFrame, n: int, direction: str = "before",
                 ts: str = "ts_us", tie: str = "request_id", at: str = "at_us",
                 hist_us: int = 60 * 1000000, on=()) -> DataFrame:
    """For every anchor instant, the `n` rows closest to it on one side
    ('before': ts <= at, newest first; 'after': ts > at, oldest first).

    No window runs over raw rows. A histogram of rows per `hist_us` bucket (its
    size is bounded by the time span, not the data) and its running count give,
    by an as-of lookup per anchor, the bucket range that holds >= n rows next to
    the anchor; only rows in that range are joined to the anchor (bucketed
    interval join) and the exact top n is taken with a salted two-level ranking.
    Output: rows + anchor columns + `rank`.
    """
    from pyspark.sql import Window
    from .topn import top_n_per_group
    if direction not in ("before", "after"):
        raise ValueError("direction must be 'before' or 'after'")
    on = list(on)
    hist = (rows.groupBy(*on, F.floor(F.col(ts) / hist_us).cast("bigint").alias("_h"))
            .agg(F.count(F.lit(1)).alias("_c")))
    w = Window.partitionBy(*on).orderBy("_h").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumn("_cum", F.sum("_c").over(w))     # rows in buckets <= _h
    span = hist.groupBy(*on).agg(F.min("_h").alias("_hmin"), F.max("_h").alias("_hmax"))
    anc = anchors.select("*", F.floor(F.col(at) / hist_us).cast("bigint").alias("_ha"))
    # as-of 1: cum of the last bucket before (or at) the anchor's own bucket
    edge = F.col("_ha") - 1 if direction == "before" else F.col("_ha")
    a1 = anc.select(*on, at, edge.alias("_key"), F.lit(1).alias("_kind"),
                    F.lit(None).cast("bigint").alias("_hv"), F.lit(None).cast("bigint").alias("_cv"))
    h1 = hist.select(*on, F.lit(None).cast("bigint").alias(at), F.col("_h").alias("_key"),
                     F.lit(0).alias("_kind"), F.col("_h").alias("_hv"), F.col("_cum").alias("_cv"))
    u = a1.unionByName(h1)
    w1 = Window.partitionBy(*on).orderBy("_key", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    base = (u.withColumn("_base", F.coalesce(F.last("_cv", ignorenulls=True).over(w1), F.lit(0)))
            .where(F.col("_kind") == 1).select(*on, at, "_base"))
    # as-of 2: the bucket where the running count crosses base -/+ n
    if direction == "before":
        tgt = base.select(*on, at, (F.col("_base") - n).alias("_key"), F.lit(1).alias("_kind"),
                          F.lit(None).cast("bigint").alias("_hv"))
        hh = hist.select(*on, F.lit(None).cast("bigint").alias(at), F.col("_cum").alias("_key"),
                         F.lit(0).alias("_kind"), F.col("_h").alias("_hv"))
        w2 = Window.partitionBy(*on).orderBy("_key", "_kind").rowsBetween(Window.unboundedPreceding, 0)
        b = (tgt.unionByName(hh).withColumn("_b", F.last("_hv", ignorenulls=True).over(w2))
             .where(F.col("_kind") == 1).select(*on, at, "_b"))
        b = b.join(span, on, "left") if on else _join_one(b, span)
        win = b.select(*on, at, F.when(F.col("_b").isNull(), F.col("_hmin") * hist_us)
                       .otherwise((F.col("_b") + 1) * hist_us).alias("_from"), F.col(at).alias("_to"))
    else:
        tgt = base.select(*on, at, (F.col("_base") + n).alias("_key"), F.lit(0).alias("_kind"),
                          F.lit(None).cast("bigint").alias("_hv"))
        hh = hist.select(*on, F.lit(None).cast("bigint").alias(at), F.col("_cum").alias("_key"),
                         F.lit(1).alias("_kind"), F.col("_h").alias("_hv"))
        # first bucket with cum >= target: a running frame over descending keys (a
        # frame to "unbounded following" would be re-evaluated per row)
        w2 = (Window.partitionBy(*on).orderBy(F.col("_key").desc(), F.col("_kind").desc())
              .rowsBetween(Window.unboundedPreceding, 0))
        b = (tgt.unionByName(hh).withColumn("_b", F.last("_hv", ignorenulls=True).over(w2))
             .where(F.col("_kind") == 0).select(*on, at, "_b"))
        b = b.join(span, on, "left") if on else _join_one(b, span)
        win = b.select(*on, at, (F.col(at) + 1).alias("_from"),
                       (F.coalesce(F.col("_b"), F.col("_hmax")) * hist_us + hist_us - 1).alias("_to"))
    # one small row per anchor
    from ..session import materialize
    win = materialize(anchors.join(win, [at] + on, "left"))
    picked = interval_join(rows, win, ts, "_from", "_to", 24 * 3600 * 1000000, on=on)
    key = [F.col(ts).desc(), F.col(tie).desc()] if direction == "before" else [F.col(ts), F.col(tie)]
    return top_n_per_group(picked, [at] + on, key, n).drop("_from", "_to")


def _join_one(a: DataFrame, b: DataFrame) -> DataFrame:
    """a x b where b has exactly one row (equi-join on a constant key)."""
    return a.withColumn("_one", F.lit(1)).join(b.withColumn("_one", F.lit(1)), "_one", "left").drop("_one")
