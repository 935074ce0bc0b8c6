"""Exact deduplication by a tree merge of sorted digest runs.

Every scan partition becomes one run of (key, smallest row, count), sorted by key and
kept as packed arrays, one row per run. Runs then meet in binomial rounds: `fan_in` (a
power of two) neighbouring runs are exchanged whole and become one by a multiway merge
over their heads. A run is sorted once, when it is made; a merge takes about
log2(`fan_in`) comparisons a row at every level. Per key it keeps the smallest
identifier and the sum of the counts, until one run is left. The key space is cut into
ranges ("slices") that merge independently, so no task ever holds more than about
`slice_rows` keys (72 bytes each), and a text that a third of all rows share is one
entry per run from the first level on. The answer goes back down per run, so joining it
to the documents splits a hot text by run as well.

A key is SHA-256, xxHash64 and byte length of the normalised text: a row only
counts as verified equal when all three agree, at every level.

Defined results: null text counts as empty; null ids sort last (a group of null ids
keeps one of them); repeated rows (same id, same text) keep exactly one; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stash

_KEY_BYTES = 48
# a packed run: keys end to end, then per key a null flag of the id (1 byte), id, row and count (8 bytes)
_RUN_SCHEMA = "slice int, run int, keys binary, missing binary, ids binary, rids binary, counts binary"
_ROOT_SCHEMA = "key binary, id long, rid long, n long"


def normalised(text: Column) -> Column:
    """Runs of space and \\t..\\r become one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _key(norm: Column) -> Column:
    def eight(c):
        return F.unhex(F.lpad(F.hex(c), 16, "0"))
    return F.concat(F.unhex(F.sha2(norm.cast("binary"), 256)), eight(F.xxhash64(norm)),
                    eight(F.octet_length(norm).cast("long")))


def _slice_of(key: Column, slices: int) -> Column:
    first = F.conv(F.hex(F.substring(key, 1, 4)), 16, 10).cast("long")
    return F.floor(first * slices / F.lit(1 << 32)).cast("int")


def _packed(key: tuple, keys: bytes, missing: bytes, ids: bytes, rids: bytes, counts: bytes) -> pa.Table:
    return pa.table({
        "slice": pa.array([key[0].as_py()], pa.int32()), "run": pa.array([key[1].as_py()], pa.int32()),
        "keys": pa.array([keys], pa.binary()), "missing": pa.array([missing], pa.binary()),
        "ids": pa.array([ids], pa.binary()), "rids": pa.array([rids], pa.binary()),
        "counts": pa.array([counts], pa.binary())})


def _make_run(key: tuple, table: pa.Table) -> pa.Table:
    """The keys of one (slice, run), each there once, as a packed run: the only sort."""
    keys = np.frombuffer(b"".join(table.column("key").to_pylist()), dtype=f"S{_KEY_BYTES}")
    order = np.argsort(keys)

    def column(name):
        return np.asarray(table.column(name).fill_null(0), dtype=np.int64)[order].tobytes()
    missing = np.asarray(table.column("id").is_null())[order].astype(np.uint8).tobytes()
    return _packed(key, keys[order].tobytes(), missing, column("id"), column("rid"), column("n"))


def _entries(row: dict) -> Iterator[tuple]:
    """(key, id is null, id, rid, count) of a packed run, in order, one at a time."""
    keys = row["keys"]
    parts = (keys[at:at + _KEY_BYTES] for at in range(0, len(keys), _KEY_BYTES))
    return zip(parts, row["missing"], *(memoryview(row[c]).cast("q") for c in ("ids", "rids", "counts")))


def merge_heads(runs: Iterable[Iterator[tuple]]) -> Iterator[tuple]:
    """Multiway merge of runs of (key, id is null, id, rid, count), each sorted by key: per
    key the smallest identifier (null last, then the first row) and the sum of the counts."""
    merged = heapq.merge(*runs)
    for entry in merged:
        break
    else:
        return
    key, missing, id_, rid, count = entry
    for other in merged:
        if other[0] == key:
            count += other[4]
        else:
            yield key, missing, id_, rid, count
            key, missing, id_, rid, count = other
    yield key, missing, id_, rid, count


def _merge_runs(key: tuple, table: pa.Table) -> pa.Table:
    """The packed runs of one (slice, parent run) as one packed run."""
    keys, missing, ids, rids, counts = bytearray(), bytearray(), array("q"), array("q"), array("q")
    for k, none, id_, rid, n in merge_heads(map(_entries, table.to_pylist())):
        keys += k
        missing.append(none)
        ids.append(id_)
        rids.append(rid)
        counts.append(n)
    return _packed(key, bytes(keys), bytes(missing), ids.tobytes(), rids.tobytes(), counts.tobytes())


def _merge_root(key: tuple, table: pa.Table) -> pa.Table:
    """The last runs of a slice as rows."""
    keys, missing, ids, rids, counts = zip(*merge_heads(map(_entries, table.to_pylist())))
    return pa.table({"key": pa.array(keys, pa.binary()),
                     "id": pa.array(ids, pa.int64(), mask=np.array(missing, dtype=bool)),
                     "rid": pa.array(rids, pa.int64()), "n": pa.array(counts, pa.int64())})


def merge_round(runs: DataFrame, fan_in: int, last: bool) -> DataFrame:
    """One exchange: `fan_in` neighbouring packed runs become one; the last round gives rows."""
    up = runs.withColumn("run", F.shiftright("run", int(math.log2(fan_in)))).groupBy("slice", "run")
    return up.applyInArrow(_merge_root, _ROOT_SCHEMA) if last else up.applyInArrow(_merge_runs, _RUN_SCHEMA)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                fan_in: int = 8, slice_rows: int = 500_000) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256. `fan_in` is a power
    of two, 2 at least."""
    if fan_in < 2 or fan_in & (fan_in - 1):
        raise ValueError(f"fan_in must be a power of two, not {fan_in}")
    rows = stash(docs.select(F.col(id_col).cast("long").alias("id"),
                             _key(normalised(F.col(text_col))).alias("key"))
                 .withColumn("run", F.spark_partition_id())
                 .withColumn("rid", F.monotonically_increasing_id())
                 .sortWithinPartitions("key"), "digest-runs")
    n_rows, last_run = rows.agg(F.count(F.lit(1)), F.max("run")).first()
    slices = max(1, math.ceil(n_rows / slice_rows))
    smallest = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid")).alias("m")
    heads = (rows.groupBy("run", "key").agg(smallest, F.count(F.lit(1)).alias("n"))
             .select(_slice_of(F.col("key"), slices).alias("slice"), "run", "key",
                     F.col("m.id").alias("id"), F.col("m.rid").alias("rid"), "n"))
    local = heads.select("run", "key")
    level = heads.groupBy("slice", "run").applyInArrow(_make_run, _RUN_SCHEMA)
    count, last = (last_run or 0) + 1, False
    while not last:
        last = count <= fan_in
        level = merge_round(level, fan_in, last)
        count = math.ceil(count / fan_in)
    root = stash(level.select("key", F.col("id").alias("keep_id"), F.col("rid").alias("keep_rid"),
                              F.col("n").alias("group_size")), "digest-root")
    answer = local.join(root, "key")
    return (rows.join(answer, ["run", "key"])
            .select(F.col("id").alias(id_col), "keep_id", "group_size",
                    (F.col("rid") == F.col("keep_rid")).alias("kept"),
                    F.lower(F.hex(F.substring("key", 1, 32))).alias("text_sha256")))
