"""Running sums per group, also for groups that no task should scan alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

SPLIT_ROWS = 500_000        # rows of one group that one task scans


def sum_before(df: DataFrame, keys, order, value: str, name: str, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Adds `name`: the sum of `value` over the rows of the same group before this one in
    `order` (0 for the first). `order` must tell the rows of a group apart; groups are
    compared as GROUP BY does (null is a group).

    Groups of up to `split_rows` rows are one window partition each. Larger ones are dealt
    to ranges of (keys, order) with sampled bounds: each range sums its own rows, and one
    row per group and range carries the total of the ranges before it.
    """
    keys, order = list(keys), list(order)
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    small = F.coalesce(F.sum(value).over(before), F.lit(0)).alias(name)
    total = df.count()
    if total <= split_rows:
        return df.select("*", small)
    big = materialize(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > split_rows))
    rows = big.agg(F.sum("_n")).first()[0]
    if not rows:
        return df.select("*", small)
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    rest = df.alias("l").join(big.alias("b"), on, "left_anti").select("*", small)
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(2, min(rows // split_rows + 1, most))
    ranged = materialize(df.alias("l").join(big.alias("b"), on, "left_semi")
                         .repartitionByRange(ranges, *keys, *order).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = (ranged.groupBy(*keys, "_range").agg(F.sum(value).alias("_sum"))
               .withColumn("_carried", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum"))
    held = ranged.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    on = held["_range"] == carried["_range"]
    for k in keys:
        on = on & held[k].eqNullSafe(carried[k])
    split = held.join(carried, on).select(*[held[c] for c in df.columns],
                                          (F.col("_inside") + F.col("_carried")).alias(name))
    return rest.unionByName(split)
