"""Exact percentiles without gathering a group's values in one task.

Spark's `percentile` keeps a value->count map per group and merges it in a single
task; a service with a third of all requests would put a third of all distinct
durations into one map. Here a percentile is found by radix descent:

1. Each value gets a log-scale bucket (64 per octave); per-(keys, bucket) counts
   are tiny and their running sum gives the bucket that holds every wanted rank.
2. While a located bucket holds more than `leaf_rows` values and more than one
   distinct value, its range is cut into 4,096 equal parts and these are counted:
   the part that holds the rank takes the bucket's place. A log bucket has at most
   2^46 distinct doubles, so four rounds end at single values whatever the data.
3. Only the values of those few leaves are shuffled and ranked exactly.

Two definitions are provided and never mixed:
  linear   position (n-1)*f, interpolated between neighbours (numpy / DuckDB
           quantile_cont / Spark percentile)
  nearest  sorted[min(n-1, floor(n*f))]  (load-generator statistics)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

_BUCKETS_PER_OCTAVE = 64
_OFFSET = 80000  # larger than |floor(log2(v) * 64)| for every finite double
_PARTS = 4096
LEAF_ROWS = 1_000_000      # values of a leaf, ranked by one task
BROADCAST_ROWS = 100_000   # located buckets, some 100 bytes each


def _log_bucket(v: Column) -> Column:
    mag = F.floor(F.log2(F.abs(v)) * _BUCKETS_PER_OCTAVE) + _OFFSET
    return (F.when(v > 0, mag).when(v < 0, -mag).otherwise(F.lit(0))).cast("bigint")


def _in_buckets(vals: DataFrame, located: DataFrame, keys, how: str) -> DataFrame:
    """Values joined with the located buckets that hold them."""
    side = located.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_kb"),
                          *[c for c in located.columns if c not in keys and c != "_b"])
    cond = (F.col("_b") == F.col("_kb")) & F.col("_v").between(F.col("_lo"), F.col("_hi"))
    for i, k in enumerate(keys):
        cond = cond & (F.col(k) == F.col(f"_k{i}"))
    if located.count() <= BROADCAST_ROWS:
        side = F.broadcast(side)
    return vals.join(side, cond, how).drop("_kb", *[f"_k{i}" for i in range(len(keys))])


def refine(vals: DataFrame, located: DataFrame, keys, leaf_rows: int) -> DataFrame:
    """Descend until every located bucket holds at most `leaf_rows` values or one value only.

    located: keys, _b, _name, _pos, _rank, _n, _before (values below it), _bc (its values),
    _lo, _hi; stored."""
    wide = (F.col("_bc") > leaf_rows) & (F.col("_lo") < F.col("_hi"))
    place = [*keys, "_b", "_name", "_pos", "_rank", "_n", "_before"]
    below = Window.partitionBy(*place).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    while not located.where(wide).isEmpty():
        share = (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
        part = F.least(F.lit(_PARTS - 1), F.floor(share * _PARTS)).cast("int")
        parts = (_in_buckets(vals, located.where(wide).drop("_bc"), keys, "inner").withColumn("_part", part)
                 .groupBy(*place, "_part").agg(F.sum("_c").alias("_bc"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
        # at most _PARTS rows per place
        parts = parts.withColumn("_below", F.col("_before") + F.coalesce(F.sum("_bc").over(below), F.lit(0)))
        found = (parts.where((F.col("_pos") >= F.col("_below")) & (F.col("_pos") < F.col("_below") + F.col("_bc")))
                 .withColumn("_before", F.col("_below")).select(*located.columns))
        located = materialize(located.where(~wide).unionByName(found))
    return located


def exact_percentiles(df: DataFrame, keys, value: str, fractions: dict,
                      method: str = "linear", count_col: str | None = None,
                      passes: int = 2, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """One row per key group with one column per entry of `fractions` (name -> f),
    plus the group's value count as `count_col` when given.

    passes=2 (default): the input is read twice or more, and only small things are
    shuffled — per-(group, bucket) counts, then the values of the few located
    leaves. passes=1: (group, value) counts are shuffled once for all values and
    stored; use it when the input is an expensive derivation that should not be
    computed twice. Nulls and NaN are ignored; groups without values produce no row.
    """
    if method not in ("linear", "nearest"):
        raise ValueError("method must be 'linear' or 'nearest'")
    if passes not in (1, 2):
        raise ValueError("passes must be 1 or 2")
    keys = list(keys)
    v = F.col(value).cast("double")
    vals = (df.select(*keys, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
            .withColumn("_b", _log_bucket(F.col("_v"))))
    if passes == 1:
        # distinct values with multiplicity (the only shuffle of full size)
        vals = materialize(vals.groupBy(*keys, "_b", "_v").agg(F.count(F.lit(1)).alias("_c")))
    else:
        vals = vals.withColumn("_c", F.lit(1).cast("bigint"))
    # per-bucket counts and their running sum: tiny
    per_bucket = vals.groupBy(*keys, "_b").agg(F.sum("_c").alias("_bc"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    order = Window.partitionBy(*keys).orderBy("_b")
    pb = (per_bucket
          .withColumn("_before", F.coalesce(F.sum("_bc").over(
              order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
          .withColumn("_n", F.sum("_bc").over(Window.partitionBy(*keys))))
    # the wanted positions that fall in each bucket (a filter, no join)
    fr = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(f)).alias("f"))
                   for name, f in fractions.items()])
    rest = [*keys, "_b", "_bc", "_lo", "_hi", "_before", "_n"]
    q = pb.select(*rest, F.explode(fr).alias("_q"))
    if method == "linear":
        rank = (F.col("_n") - 1).cast("double") * F.col("_q.f")
        q = q.select(*rest, F.col("_q.name").alias("_name"), rank.alias("_rank"))
        q = q.select("*", F.explode(F.array_distinct(F.array(
            F.floor("_rank").cast("bigint"), F.ceil("_rank").cast("bigint")))).alias("_pos"))
    else:
        pos = F.least(F.col("_n") - 1, F.floor(F.col("_n").cast("double") * F.col("_q.f")))
        q = q.select(*rest, F.col("_q.name").alias("_name"),
                     F.lit(None).cast("double").alias("_rank"), pos.cast("bigint").alias("_pos"))
    located = materialize(q.where((F.col("_pos") >= F.col("_before"))
                                  & (F.col("_pos") < F.col("_before") + F.col("_bc"))))
    located = refine(vals, located, keys, leaf_rows)
    # keep only the values of located leaves (a semi-join with at most groups x fractions x 2
    # rows), count them, and rank the distinct ones
    counts = (_in_buckets(vals, located.select(*keys, "_b", "_lo", "_hi"), keys, "left_semi")
              .groupBy(*keys, "_b", "_v").agg(F.sum("_c").alias("_c")))
    sel = _in_buckets(counts, located, keys, "inner")
    w = (Window.partitionBy(*keys, "_b", "_name", "_pos").orderBy("_v")
         .rowsBetween(Window.unboundedPreceding, 0))
    cum = F.sum("_c").over(w)
    inner = F.col("_pos") - F.col("_before")
    at = (sel.withColumn("_cum", cum)
          .where((inner >= F.col("_cum") - F.col("_c")) & (inner < F.col("_cum"))))
    # one row per group: interpolate between the neighbouring positions
    aggs = []
    for name in fractions:
        pick = F.col("_name") == name
        lo = F.min(F.when(pick, F.struct("_pos", "_v")))["_v"]
        if method == "linear":
            hi = F.max(F.when(pick, F.struct("_pos", "_v")))["_v"]
            r = F.max(F.when(pick, F.col("_rank")))
            aggs.append((lo + (hi - lo) * (r - F.floor(r))).alias(name))
        else:
            aggs.append(lo.alias(name))
    if count_col:
        aggs.append(F.max("_n").alias(count_col))
    return at.groupBy(*keys).agg(*aggs)


def bounded_median(col) -> Column:
    """Median (mean of the middle two) for groups known to be small, e.g. per-step
    points of one series in a baseline window. Not for raw-row groups."""
    return F.percentile(F.col(col) if isinstance(col, str) else col, 0.5)
