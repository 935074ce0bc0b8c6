"""Compression of vectors into codes by codebooks per part, with equal-average search.

A component x becomes the integer floor(1024 x). Vectors are cut into equal parts; each
part position has a codebook that starts as that part of the first vectors (by id) and is
refined by rounds: every part goes to its nearest entry, then each entry becomes the
floored mean of its parts. All of it is integer arithmetic, so results do not depend on
how rows are dealt to tasks.

The nearest entry is found by equal-average search: the entries of a codebook lie sorted
by component sum, and since (sum x - sum y)^2 / d <= |x - y|^2, a search that starts at
the part's own sum and goes outward may stop as soon as that bound strictly exceeds the
best distance (strictly, so that ties still reach the lower index). Rows are searched in
blocks of like sums: a block's window of entries grows on both sides, for the rows that
have not stopped.

A round is one job: tasks send the sums and counts of their parts per entry (their number
is bounded by the codebook, not by the rows), Spark adds them, and the driver receives one
row per entry: parts x entries x components numbers, whatever the number of vectors. The
codebooks travel with the function of the next round.

Defined results: rows whose vector is null, empty, or holds null or non-finite components
are dropped; so are vectors of another length than the first one's (the kept row with the
smallest id); a length that is no multiple of the parts is filled up with zeros; integers
lie within 2^27 of zero (components beyond 131,072 count as that); null ids follow all
others; of rows with equal ids, the smaller vector is first; fewer rows than entries give
shorter codebooks; an empty table gives no rows and no codebook.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import BROADCAST_ROWS, shuffle_partitions, stash

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LIMIT = 1 << 27
_BLOCK, _STEP = 512, 24      # rows of a block, entries by which its window grows
_EXACT = 1 << 53             # integers up to here are exact as doubles


def integers(vector: Column) -> Column:
    """floor(1024 x) per component, within the limit."""
    return F.transform(vector, lambda x: F.floor(
        F.greatest(F.lit(float(-LIMIT)), F.least(F.lit(float(LIMIT)), x.cast("double") * SCALE))).cast("int"))


def usable(vector: Column) -> Column:
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & good


class Codebook:
    """The entries of one part, sorted by component sum (ties by index)."""

    def __init__(self, entries: np.ndarray):
        sums = entries.sum(axis=1)
        self.order = np.argsort(sums, kind="stable")
        self.sums = sums[self.order]
        self.entries = entries[self.order]
        self.biggest = int(np.abs(entries).max(initial=0))

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the entry nearest to each row, lower index on ties."""
        n, d = parts.shape
        index, best = np.empty(n, np.int64), np.empty(n, np.int64)
        # products as doubles where they are exact, else as Python integers
        most = max(self.biggest, int(np.abs(parts).max(initial=0)))
        kind = np.float64 if 4 * d * d * most * most < _EXACT else object
        entries, rows = self.entries.astype(kind), parts.astype(kind)
        squares = (entries * entries).sum(axis=1)
        own = (rows * rows).sum(axis=1)
        sums = parts.sum(axis=1)
        by_sum = np.argsort(sums, kind="stable")
        for at in range(0, n, _BLOCK):
            block = by_sum[at:at + _BLOCK]
            self._block(rows[block], own[block], sums[block], entries, squares, d, block, index, best)
        return index, best

    def _block(self, rows, own, sums, entries, squares, d, block, index, best):
        found = np.full(len(block), -1, np.int64)
        dist = np.full(len(block), -1, rows.dtype)

        def compare(who, lo, hi):
            """The rows `who` meet the entries [lo, hi)."""
            number = np.argsort(self.order[lo:hi])          # lower indexes first
            here = own[who, None] - 2 * (rows[who] @ entries[lo:hi][number].T) + squares[lo:hi][number]
            column = here.argmin(axis=1)
            value = here[np.arange(len(who)), column]
            which = self.order[lo:hi][number][column]
            old, old_index = dist[who], found[who]
            better = (old_index < 0) | (value < old) | ((value == old) & (which < old_index))
            dist[who[better]], found[who[better]] = value[better], which[better]

        size = len(self.sums)
        lo = min(int(np.searchsorted(self.sums, sums[0])), size - 1)
        hi = max(int(np.searchsorted(self.sums, sums[-1], side="right")), lo + 1)
        compare(np.arange(len(block)), lo, hi)
        exact = object if dist.dtype == object else np.int64
        while lo > 0 or hi < size:
            reach = dist.astype(exact) * d
            if lo > 0:
                gap = (sums - self.sums[lo - 1]).astype(exact)
                left = np.flatnonzero(~(gap * gap > reach))
                to = max(0, lo - _STEP)
                if len(left):
                    compare(left, to, lo)
                lo = to if len(left) else 0
            if hi < size:
                gap = (self.sums[hi] - sums).astype(exact)
                right = np.flatnonzero(~(gap * gap > reach))
                to = min(size, hi + _STEP)
                if len(right):
                    compare(right, hi, to)
                hi = to if len(right) else size
        index[block] = found
        best[block] = dist.astype(np.int64)


def _matrix(column: pa.Array, parts: int) -> np.ndarray:
    """Rows x parts x components of an Arrow column of lists of equal length."""
    flat = np.asarray(column.flatten(), np.int64)
    n = len(column)
    size = len(flat) // n if n else 0
    rows = np.pad(flat.reshape(n, size), ((0, 0), (0, -size % parts)))
    return rows.reshape(n, parts, rows.shape[1] // parts)


def _sums(books: list[np.ndarray]):
    """Sums and counts of a task's parts per (part, entry)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Codebook(b) for b in books]
        totals = [np.zeros(b.shape, np.int64) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            rows = _matrix(batch.column(0), len(books))
            for p in range(len(books)) if len(rows) else ():
                index, _ = search[p].nearest(rows[:, p])
                order = np.argsort(index, kind="stable")
                used, first, n = np.unique(index[order], return_index=True, return_counts=True)
                totals[p][used] += np.add.reduceat(rows[order, p], first)
                counts[p][used] += n
        out = [(p, e, int(counts[p][e]), totals[p][e]) for p in range(len(books)) for e in np.flatnonzero(counts[p])]
        yield pa.RecordBatch.from_arrays(
            [pa.array([o[0] for o in out], pa.int32()), pa.array([int(o[1]) for o in out], pa.int32()),
             pa.array([o[2] for o in out], pa.int64()), pa.array([o[3] for o in out], pa.list_(pa.int64()))],
            names=["part", "entry", "n", "sums"])
    return run


def refined(vectors: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """One round: every part goes to its nearest entry, entries become floored means."""
    partial = vectors.select("v").mapInArrow(_sums(books), "part int, entry int, n long, sums array<long>")
    one = partial.select("part", "entry", "n", F.posexplode("sums").alias("at", "sum"))
    total = one.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum")).toArrow()
    out = [b.copy() for b in books]
    part, entry, at, n, s = (np.asarray(total[c]) for c in ("part", "entry", "at", "n", "sum"))
    for p in range(len(books)):
        mine = part == p
        out[p][entry[mine], at[mine]] = s[mine] // n[mine]
    return out


def first_entries(vectors: DataFrame, parts: int, entries: int) -> list[np.ndarray]:
    """The parts of the vectors with the smallest ids."""
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").toArrow()["v"].combine_chunks()
    rows = _matrix(first, parts)
    return [rows[:, p].copy() for p in range(parts)]


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks of a stored table with `id` and integer vectors `v`."""
    books = first_entries(vectors, parts, entries)
    for _ in range(rounds if len(books[0]) else 0):
        books = refined(vectors, books)
    return books


def fingerprint(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def _codes(books: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Codebook(b) for b in books]
        for batch in batches:
            rows = _matrix(batch.column(1), len(books))
            found = [search[p].nearest(rows[:, p]) for p in range(len(books))] if len(rows) else []
            codes = np.stack([f[0] for f in found], axis=1) if found else np.zeros((0, len(books)), np.int64)
            error = sum((f[1] for f in found), np.zeros(len(rows), np.int64))
            offsets = np.arange(len(rows) + 1, dtype=np.int32) * len(books)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(offsets, codes.ravel().astype(np.int32)), pa.array(error)],
                names=["row", "codes", "error"])
    return run


def prepared(table: DataFrame, keep: list[Column], id_col: str = "vec_id",
             vector_col: str = "embedding") -> DataFrame:
    """The rows that take part, stored: row (struct of the columns in `keep`), id, v."""
    rows = table.where(usable(F.col(vector_col))).select(
        F.struct(*keep).alias("row"), F.col(id_col).cast("long").alias("id"),
        integers(F.col(vector_col)).alias("v"))
    rows = stash(rows, "vectors")
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").select(F.size("v").alias("n")).limit(1).collect()
    return rows.where(F.size("v") == first[0].n) if first else rows


def compress(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """row, codes (entry index per part), error (squared distances summed over the parts) of a
    table made by `prepared`."""
    schema = vectors.select("row", F.array(F.lit(0)).alias("codes"), F.lit(0).cast("long").alias("error")).schema
    return vectors.select("row", "v").mapInArrow(_codes(books), schema)


def decompress(codes: list[int], books: list[np.ndarray]) -> list[float]:
    """The vector that a code stands for (with the zeros that filled it up)."""
    return [x / SCALE for b, c in zip(books, codes) for x in b[c].tolist()]


def with_group_sum(rows: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """Adds the sum of `value` over rows of equal `group` (nulls together) to a stored table.
    Few groups are broadcast; of many, those with more rows than a partition's share are
    (fewer than partitions), the rest is joined by a shuffle."""
    sums = stash(rows.groupBy(F.col(group).alias("_group")).agg(
        F.sum(value).alias(name), F.count(F.lit(1)).alias("_n")), "group-sums")
    same = F.col(group).eqNullSafe(F.col("_group"))
    if sums.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(sums.drop("_n")), same).drop("_group")
    share = rows.count() // shuffle_partitions(rows.sparkSession) + 1
    hot = F.broadcast(sums.where(F.col("_n") > share).drop("_n"))
    often = rows.join(hot, same).drop("_group")
    rare = rows.join(hot.select("_group"), same, "left_anti").join(sums.where(F.col("_n") <= share).drop("_n"), same)
    return often.unionByName(rare.drop("_group"))
