"""Removal of repeated substrings by a distributed merge sort of sampled suffixes.

Every byte that lies in a `WINDOW`-byte string which also starts earlier is removed;
"earlier" is a smaller id or, in one document, a smaller start.

Suffixes are sampled so that none that matters is lost: the anchor of a window is the
leftmost GRAM-byte substring with the smallest hash inside it. Equal windows have equal
anchors at equal places, and neighbouring windows mostly share one, so each window start
belongs to exactly one anchor and there is about one anchor per 35 bytes.

1. Anchors whose GRAM bytes occur once cannot be in a repeated window. Hashes are counted
   (summed per task first) and joined back; the rest of the work is on repeated anchors.
2. Every task sorts the suffixes at its repeated anchors (just as long as their windows
   reach) into runs. Equal ones collapse to the first, the others are covered at once.
   Runs are front-coded (shared prefix length and the rest) and sent to slices of the
   anchor hash.
3. A slice merges its runs with a loser tree that keeps, per node, the length of the
   prefix its loser shares with the last output: two heads are compared by those lengths,
   and bytes are only read from the first unknown one on. The result is the sorted
   sequence with the common prefix of every neighbour.
4. A window that starts d bytes before its anchor is a group of neighbours whose common
   prefix is WINDOW - d or more and whose d bytes before the anchor are equal too. In
   every group all but the earliest are covered.
5. The covered intervals go back to the documents and are cut out.

An anchor with more than `hot_rows` occurrences is not merged in one slice: its windows
are spread by a 128-bit hash of their own bytes, collapsed per task first. That way is as
exact and has no group larger than one row per task and window.

Defined results: null text counts as empty; null ids come last; rows sharing an id but
not the text are ordered by a hash; rows equal in id and text have one position, so none
removes from the other; an empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import Substrings
from .store import begin_task, end_task, stash, tidy

WINDOW = 100
GRAM = 32
HOT_ROWS = 250_000
SLICE_BYTES = 8 << 20          # of input text per slice; its repeated suffixes are less
RUN_BYTES = 16 << 20           # of suffixes that a task holds before it sends a run
_LAST_ID = (1 << 63) - 1
_HIGH = np.uint64(0xFFFFFFFF00000000)
_LOW = np.uint64(0xFFFFFFFF)


class Anchors:
    """The anchors of a text: gram hash, place, first window start, number of starts."""

    def __init__(self):
        self.hashes = Substrings()

    def of(self, data: np.ndarray):
        if len(data) < WINDOW:
            return None
        gram = self.hashes.sliding(self.hashes.prefix(data), GRAM)
        # order by the hash's upper half, then by place: the leftmost smallest
        least = (gram & _HIGH) | np.arange(len(gram), dtype=np.uint64)
        span, width = WINDOW - GRAM + 1, 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[:len(least) - (span - width)], least[span - width:])
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        place = (least[first] & _LOW).astype(np.int64)
        return gram[place], place, first, np.diff(np.append(first, len(least)))


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    anchors = Anchors()
    for batch in batches:
        found = [a[0] for t in batch.column(0)
                 if (a := anchors.of(np.frombuffer(_bytes(t.as_py()), np.uint8)))]
        gram, n = np.unique(np.concatenate(found), return_counts=True) if found else (
            np.empty(0, np.uint64), np.empty(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n)], names=["gram", "n"])


def _list_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    anchors = Anchors()
    for batch in batches:
        keys, ids, grams = [], [], []
        for k, i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            a = anchors.of(np.frombuffer(_bytes(t.as_py()), np.uint8))
            if a:
                gram = np.unique(a[0])
                grams.append(gram)
                keys.append(np.full(len(gram), k, np.int64))
                ids.append(np.full(len(gram), i, np.int64))
        if grams:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys)), pa.array(np.concatenate(ids)),
                 pa.array(np.concatenate(grams).view(np.int64))], names=["k", "id", "gram"])


# --- runs ---------------------------------------------------------------------------

_RUN, _COVER, _WINDOWS = 0, 1, 2
_POSITION = np.dtype([("id", "<i8"), ("k", "<i8"), ("place", "<i4"), ("before", "<i2"), ("starts", "<i2")])
_INTERVAL = np.dtype([("k", "<i8"), ("id", "<i8"), ("start", "<i4"), ("end", "<i4")])
_WINDOW_ROW = np.dtype([("print", "S16"), ("id", "<i8"), ("k", "<i8"), ("start", "<i4")])


def _pack(*parts: bytes) -> bytes:
    raw = b"".join(len(p).to_bytes(8, "little") + p for p in parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(data: bytes) -> list[bytes]:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    out, at = [], 0
    while at < len(raw):
        n = int.from_bytes(raw[at:at + 8], "little")
        out.append(raw[at + 8:at + 8 + n])
        at += 8 + n
    return out


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix; the first `known` bytes are known to be equal."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


def encode_run(rows: list[tuple[bytes, bytes, tuple]]) -> bytes:
    """(suffix, bytes before it, position) sorted by suffix, front-coded."""
    shared, last = [], b""
    for suffix, _, _ in rows:
        shared.append(common_prefix(last, suffix))
        last = suffix
    return _pack(np.array(shared, "<u2").tobytes(), np.array([len(r[0]) for r in rows], "<u2").tobytes(),
                 b"".join(r[0][s:] for r, s in zip(rows, shared)), b"".join(r[1] for r in rows),
                 np.array([r[2] for r in rows], _POSITION).tobytes())


def decode_run(data: bytes) -> tuple[list[bytes], list[int], np.ndarray, bytes]:
    """Suffixes, prefix shared with the one before, positions, the bytes before (joined)."""
    shared, size, rest, before, position = _unpack(data)
    shared, size = np.frombuffer(shared, "<u2").tolist(), np.frombuffer(size, "<u2").tolist()
    out, last, at = [], b"", 0
    for s, n in zip(shared, size):
        last = last[:s] + rest[at:at + n - s]
        at += n - s
        out.append(last)
    return out, shared, np.frombuffer(position, _POSITION), before


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Merge sorted runs (strings, prefix shared with the one before): the order as (run,
    place) and the prefix every output shares with the one before.

    A node of the loser tree holds the run that lost there and the prefix its head shares
    with the last output (-1: the run is used up). Of two heads, the one that shares more
    with the last output is smaller; only equal lengths need bytes, from there on.
    """
    n = 1
    while n < len(runs):
        n *= 2
    heads = [0] * n
    texts = [r[0] for r in runs] + [[]] * (n - len(runs))
    shared = [r[1] for r in runs] + [[]] * (n - len(runs))
    loser, known = [0] * n, [0] * n

    def duel(a, la, b, lb):
        """(winner, its prefix, loser, its prefix)"""
        if la != lb:
            return (a, la, b, lb) if la > lb else (b, lb, a, la)
        if la < 0:
            return a, la, b, lb
        x, y = texts[a][heads[a]], texts[b][heads[b]]
        both = common_prefix(x, y, la)
        if both == len(x) or (both < len(y) and x[both] < y[both]):
            return a, la, b, both
        return b, lb, a, both

    def build(node):
        if node >= n:
            run = node - n
            return run, 0 if texts[run] else -1
        a, la = build(2 * node)
        b, lb = build(2 * node + 1)
        w, lw, loser[node], known[node] = duel(a, la, b, lb)
        return w, lw

    order, prefixes = [], []
    winner, length = build(1) if n > 1 else (0, 0 if texts[0] else -1)
    while length >= 0:
        at = heads[winner]
        order.append((winner, at))
        prefixes.append(length)
        heads[winner] = at = at + 1
        length = shared[winner][at] if at < len(texts[winner]) else -1
        node = (winner + n) >> 1
        while node:
            other = known[node]
            if length < other:
                winner, loser[node] = loser[node], winner
                known[node], length = length, other
            elif length == other and length >= 0:
                winner, length, loser[node], known[node] = duel(winner, length, loser[node], other)
            node >>= 1
    return order, prefixes


class _Runs:
    """Suffixes a task has collected, by slice."""

    def __init__(self, slices: int):
        self.slices, self.size = slices, 0
        self.suffixes: dict[int, list] = {}
        self.windows: dict[bytes, tuple] = {}
        self.cover: list[tuple] = []

    def add(self, data: bytes, k: int, id_: int, a, wanted: np.ndarray, hot: np.ndarray) -> None:
        gram, place, first, starts = a
        keep = np.flatnonzero(np.isin(gram, wanted))
        is_hot = np.isin(gram[keep], hot)
        slices = (gram[keep] % np.uint64(self.slices)).tolist()
        for s, h, q, lo, n in zip(slices, is_hot.tolist(), place[keep].tolist(), first[keep].tolist(),
                                  starts[keep].tolist()):
            if h:
                self._add_windows(data, k, id_, lo, n)
                continue
            row = (data[q:lo + n - 1 + WINDOW], data[lo:q], (id_, k, q, q - lo, n))
            self.suffixes.setdefault(s, []).append(row)
            self.size += 2 * WINDOW

    def _add_windows(self, data: bytes, k: int, id_: int, lo: int, n: int) -> None:
        for p in range(lo, lo + n):
            mark = xxhash.xxh3_128_digest(data[p:p + WINDOW])
            here, old = (id_, k, p), self.windows.get(mark)
            if old is None:
                self.windows[mark] = here
                self.size += 200
            elif here != old:
                late = max(here, old)
                self.windows[mark] = min(here, old)
                self._cover(late[1], late[0], late[2], late[2] + WINDOW)

    def _cover(self, k: int, id_: int, start: int, end: int) -> None:
        self.cover.append((k, id_, start, end))
        self.size += 100

    def flush(self) -> pa.RecordBatch:
        rows = []
        for s, found in self.suffixes.items():
            found.sort()
            run, last = [], None
            for row in found:
                if last is not None and row[:2] == last[:2]:
                    id_, k, q, before, n = row[2]
                    if row[2] != last[2]:
                        self._cover(k, id_, q - before, q - before + n - 1 + WINDOW)
                    continue
                run.append(row)
                last = row
            rows.append((s, _RUN, encode_run(run)))
        spread: dict[int, list] = {}
        for c in self.cover:
            spread.setdefault(c[0] % self.slices, []).append(c)
        rows += [(s, _COVER, _pack(np.array(c, _INTERVAL).tobytes())) for s, c in spread.items()]
        spread = {}
        for mark, (id_, k, p) in self.windows.items():
            spread.setdefault(int.from_bytes(mark[:8], "little") % self.slices, []).append((mark, id_, k, p))
        rows += [(s, _WINDOWS, _pack(np.array(w, _WINDOW_ROW).tobytes())) for s, w in spread.items()]
        self.__init__(self.slices)
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
             pa.array([r[2] for r in rows], pa.binary())], names=["slice", "kind", "data"])


def _make_runs(slices: int, run_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, runs = Anchors(), _Runs(slices)
        for batch in batches:
            for k, id_, text, grams, hot in zip(batch.column("k").to_pylist(), batch.column("id").to_pylist(),
                                                batch.column("text"), batch.column("grams"), batch.column("hot")):
                data = _bytes(text.as_py())
                a = anchors.of(np.frombuffer(data, np.uint8))
                wanted = np.array(grams.as_py(), np.int64).view(np.uint64)
                runs.add(data, k, id_, a, wanted, np.array(hot.as_py(), np.int64).view(np.uint64))
                if runs.size >= run_bytes:
                    yield runs.flush()
        yield runs.flush()
    return run


# --- slices -------------------------------------------------------------------------

def _left_groups(before: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each left side read backwards, and the prefix shared by rank neighbours."""
    width = WINDOW - GRAM
    ends = np.cumsum(sizes)
    flat = np.frombuffer(before, np.uint8)
    sides = np.zeros((len(sizes), width), np.uint8)
    for d in range(1, width + 1):
        has = sizes >= d
        sides[has, d - 1] = flat[ends[has] - d]
    order = np.argsort(sides.view(f"S{width}").ravel(), kind="stable")
    inside = sides[order]
    equal = np.cumprod(inside[1:] == inside[:-1], axis=1).sum(axis=1)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank, np.concatenate([[-1], equal])


def covered(prefixes: np.ndarray, position: np.ndarray, before: bytes) -> np.ndarray:
    """Intervals covered, of suffixes in sorted order (prefix shared with the one before,
    position, the bytes before each joined in the same order)."""
    n = len(position)
    d_high = position["before"].astype(np.int64)
    d_low = d_high - position["starts"] + 1
    rank, left = _left_groups(before, d_high)
    by_position = np.lexsort((position["place"], position["k"], position["id"]))
    same = np.zeros(n, bool)       # the position of the one before in that order
    p = position[by_position]
    same[1:] = ((p["id"][1:] == p["id"][:-1]) & (p["k"][1:] == p["k"][:-1]) & (p["place"][1:] == p["place"][:-1]))
    number = np.empty(n, np.int64)
    number[by_position] = np.cumsum(~same)
    out, run_from = [], np.full(n, -1, np.int64)

    def close(which, d):
        x = position[which]
        row = np.empty(len(which), _INTERVAL)
        row["k"], row["id"] = x["k"], x["id"]
        row["start"] = x["place"] - (d - 1)
        row["end"] = x["place"] - run_from[which] + WINDOW
        out.append(row)
        run_from[which] = -1

    for d in range(WINDOW - GRAM + 1):
        right_group = np.cumsum(prefixes < WINDOW - d)
        left_group = np.cumsum(left < d)[rank]
        some = by_position[(d_low[by_position] <= d) & (d_high[by_position] >= d)]
        key = right_group[some] * np.int64(n + 2) + left_group[some]
        order = np.argsort(key, kind="stable")
        sorted_key, who = key[order], some[order]
        first = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])[:len(who)]
        earliest = number[who[np.maximum.accumulate(np.where(first, np.arange(len(who)), 0))]] if len(who) else number[:0]
        late = np.zeros(n, bool)
        late[who[number[who] > earliest]] = True
        ended = np.flatnonzero(~late & (run_from >= 0))
        if len(ended):
            close(ended, d)
        run_from[late & (run_from < 0)] = d
    open_ = np.flatnonzero(run_from >= 0)
    if len(open_):
        close(open_, WINDOW - GRAM + 1)
    return np.concatenate(out) if out else np.empty(0, _INTERVAL)


def _merge_task(key: tuple, table: pa.Table) -> pa.Table:
    begin_task(None)
    try:
        return _merge_slice(table)
    finally:
        end_task()


def _merge_slice(table: pa.Table) -> pa.Table:
    kinds = table.column("kind").to_pylist()
    data = table.column("data").to_pylist()
    parts = [np.frombuffer(_unpack(d)[0], _INTERVAL) for kind, d in zip(kinds, data) if kind == _COVER]
    rows = [np.frombuffer(_unpack(d)[0], _WINDOW_ROW) for kind, d in zip(kinds, data) if kind == _WINDOWS]
    runs = []
    for at, kind in enumerate(kinds):
        if kind == _RUN:
            runs.append(decode_run(data[at]))
        data[at] = None
    if runs:
        order, prefixes = merge_runs([(r[0], r[1]) for r in runs])
        position = np.empty(len(order), _POSITION)
        run = np.fromiter((o[0] for o in order), np.int64, len(order))
        at = np.fromiter((o[1] for o in order), np.int64, len(order))
        del order
        runs = [r[2:] for r in runs]            # the suffixes are done with
        before: list = [None] * len(at)
        for i, (places, sides) in enumerate(runs):
            mine = np.flatnonzero(run == i)
            position[mine] = places[at[mine]]
            ends = np.cumsum(places["before"].astype(np.int64))
            for slot, end, size in zip(mine.tolist(), ends[at[mine]].tolist(), places["before"][at[mine]].tolist()):
                before[slot] = sides[end - size:end]
        parts.append(covered(np.array(prefixes), position, b"".join(before)))
    if rows:
        w = np.concatenate(rows)
        # the last byte of a print may be zero, which "S16" pads alike: 16 bytes are compared
        w = w[np.lexsort((w["start"], w["k"], w["id"], w["print"]))]
        first = np.concatenate([[True], w["print"][1:] != w["print"][:-1]])
        lead = w[np.maximum.accumulate(np.where(first, np.arange(len(w)), 0))]
        late = w[(w["id"] != lead["id"]) | (w["k"] != lead["k"]) | (w["start"] != lead["start"])]
        row = np.empty(len(late), _INTERVAL)
        row["k"], row["id"], row["start"], row["end"] = late["k"], late["id"], late["start"], late["start"] + WINDOW
        parts.append(row)
    out = np.concatenate(parts) if parts else np.empty(0, _INTERVAL)
    return pa.table({c: pa.array(np.ascontiguousarray(out[c])) for c in ("k", "id", "start", "end")})


# --- documents ----------------------------------------------------------------------

def _cut(with_kept: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
            for text, starts, ends in zip(batch.column("text"), batch.column("starts"), batch.column("ends")):
                data = _bytes(text.as_py())
                spans = merged(sorted(zip(starts.as_py() or (), ends.as_py() or ())))
                view, at, kept = memoryview(data), 0, []
                for a, b in [*spans, (len(data), len(data))]:
                    kept.append(view[at:a])
                    at = b
                digest = hashlib.sha256()
                for part in kept:
                    digest.update(part)
                out["n_bytes"].append(len(data))
                out["n_removed"].append(sum(b - a for a, b in spans))
                out["n_spans"].append(len(spans))
                out["kept_sha256"].append(digest.hexdigest())
                out["kept"].append(b"".join(kept) if with_kept else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")),
                 pa.array(out["kept_sha256"], pa.string()), pa.array(out["kept"], pa.binary())],
                names=["doc_id", *out])
    return run


def merged(spans) -> list[tuple[int, int]]:
    """Maximal runs of sorted intervals; touching ones are one run."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def covers(texts: DataFrame, slices: int, hot_rows: int = HOT_ROWS, run_bytes: int = RUN_BYTES) -> DataFrame:
    """k, id, start, end (bytes): intervals to remove, of texts (k, id, doc_id, text)."""
    counts = (texts.select("text").mapInArrow(tidy(_count_grams), "gram long, n long")
              .groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1")
              .select("gram", (F.col("n") > hot_rows).alias("hot")))
    listed = texts.select("k", "id", "text").mapInArrow(tidy(_list_grams), "k long, id long, gram long")
    repeated = (listed.join(counts, "gram").groupBy("k", "id")
                .agg(F.collect_set("gram").alias("grams"),
                     F.collect_set(F.when(F.col("hot"), F.col("gram"))).alias("hot")))
    # all columns of `texts`, unused ones too: the join that cuts reuses this exchange
    runs = (texts.join(repeated, ["k", "id"])
            .mapInArrow(tidy(_make_runs(slices, run_bytes)), "slice int, kind int, data binary"))
    return runs.groupBy("slice").applyInArrow(_merge_task, "k long, id long, start int, end int")


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             hot_rows: int = HOT_ROWS, run_bytes: int = RUN_BYTES, with_kept: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left, if asked for).
    Stored: the tasks take texts in small batches, whatever the session's setting."""
    id_ = F.col(id_col).cast("long")
    texts = docs.select(F.xxhash64(id_, F.col(text_col)).alias("k"),
                        F.coalesce(id_, F.lit(_LAST_ID)).alias("id"), id_.alias("doc_id"),
                        F.col(text_col).alias("text"))
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    found = covers(texts, max(1, math.ceil(size / SLICE_BYTES)), hot_rows, run_bytes)
    lists = found.groupBy("k", "id").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    out = (texts.join(lists, ["k", "id"], "left").select("doc_id", "text", "starts", "ends")
           .mapInArrow(tidy(_cut(with_kept)), "doc_id long, n_bytes long, n_removed long, n_spans long, "
                                              "kept_sha256 string, kept binary"))
    return stash(out if with_kept else out.drop("kept"), "removals").withColumnRenamed("doc_id", id_col)
