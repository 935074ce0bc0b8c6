"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass one scatters every record into one of `buckets` buckets by a seeded hash of its
row number in the scan; a bucket holds about `bucket_bytes` of its records' strings and
binaries. (A hash of the id would put a third of all rows into one bucket when a third
of the ids are equal or null.) The number of partitions follows the number of buckets,
so a task gathers about four of them, however many there are in all. Pass two puts each bucket through Spark's `shuffle`, a seeded Fisher-Yates
over the bucket's array, and writes it. The shards are then consecutive stretches of
the written buckets.

Law `rows`: shard sizes differ by one row at most; slots count from 0 in each shard.

The permutation is fixed by the seed, the table's split into scan partitions and
spark.sql.shuffle.partitions; it is written once, so a lost executor cannot change it.

Defined results: any value may be null; a null text has size 1; repeated rows are
separate records; an empty table gives no rows; the input's columns come back in the
struct `record`, so no name can clash with `shard` or `slot`.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import shuffle_partitions, stash

# an offset row has two longs; a million of them (16 MB) may be broadcast
BROADCAST_BUCKETS = 1_000_000
_BLOCK = 4096
_BUCKETS_A_TASK = 4


def record_size(text):
    """UTF-8 bytes of the text (null: none) plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def gathered_size(docs: DataFrame):
    """Bytes of a record as pass two gathers it: its strings and binaries, 16 for any other column."""
    size = F.lit(0).cast("long")
    for field in docs.schema:
        if field.dataType.typeName() in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(F.col(f"`{field.name}`")), F.lit(0))
        else:
            size = size + 16
    return size


def scatter(docs: DataFrame, buckets: int, seed: int) -> DataFrame:
    """Pass one: bucket, rid, record; the rows of a bucket in one partition, by rid."""
    rows = (docs.select(F.struct("*").alias("record"))
            .withColumn("rid", F.monotonically_increasing_id())
            .withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "rid"), F.lit(buckets))))
    parts = max(math.ceil(buckets / _BUCKETS_A_TASK), shuffle_partitions(docs.sparkSession))
    return (rows.repartition(parts, "bucket")
            .sortWithinPartitions("bucket", "rid"))


def shuffle_buckets(scattered: DataFrame, seed: int) -> DataFrame:
    """Pass two: the records of each bucket in Fisher-Yates order (bucket, pos, record)."""
    return (scattered.groupBy("bucket").agg(F.collect_list("record").alias("records"))
            .select("bucket", F.posexplode(F.shuffle("records", seed)).alias("pos", "record")))


def _offsets(written: DataFrame) -> DataFrame:
    """Rows before each bucket, as a two-level running sum (blocks of 4,096 buckets)."""
    counts = (written.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("block", F.floor(F.col("bucket") / _BLOCK)))
    blocks = counts.groupBy("block").agg(F.sum("n").alias("block_n"))
    before = (blocks.withColumn("block_before", F.sum("block_n").over(
        Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
        .select("block", F.coalesce("block_before", F.lit(0)).alias("block_before")))
    inner = Window.partitionBy("block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return (counts.withColumn("before", F.coalesce(F.sum("n").over(inner), F.lit(0)))
            .join(before, "block")
            .select("bucket", (F.col("before") + F.col("block_before")).alias("before")))


def shuffle_to_shards(docs: DataFrame, shards: int = 8,
                      seed: int = 20240229, bucket_bytes: int = 16 << 20) -> DataFrame:
    """Every record once: record (struct of the input's columns), shard, slot."""
    total, size = docs.agg(F.count(F.lit(1)), F.sum(gathered_size(docs))).first()
    buckets = max(1, math.ceil((size or 0) / bucket_bytes))
    written = stash(shuffle_buckets(scatter(docs, buckets, seed), seed), "shuffled-buckets")
    offsets = _offsets(written)
    if buckets <= BROADCAST_BUCKETS:
        offsets = F.broadcast(offsets)
    base, extra = divmod(total, shards)
    # the first `extra` shards hold base + 1 rows, the others base
    at = F.col("before") + F.col("pos")
    long_rows = extra * (base + 1)
    shard = (F.when(at < long_rows, F.floor(at / (base + 1)))
             .otherwise(extra + F.floor((at - long_rows) / max(base, 1))))
    start = F.when(F.col("shard") < extra, F.col("shard") * (base + 1)).otherwise(
        long_rows + (F.col("shard") - extra) * base)
    return (written.join(offsets, "bucket")
            .select("record", at.alias("at"), shard.cast("int").alias("shard"))
            .select("record", "shard", (F.col("at") - start).cast("long").alias("slot")))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order inside each file."""
    (sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .select("shard", "slot", "record.*").write.partitionBy("shard").parquet(path))
