"""N-gram Jaccard join: T-occurrence search (DivideSkip) over shingle sets, exact.

A document's set: hashes of its distinct `n`-word shingles over lower-cased words (with
fewer words, the whole sequence is one shingle). Two documents link when
den * |A and B| >= num * |A or B| (num/den the Jaccard bound as integers).

1. One pass over the texts writes, per document, its set's size and fingerprint and its
   lowest shingle hashes, a fraction a little above the share A of its shingles that a
   linked set may lack. Counting these over all documents shows which occur only once; a
   document with more than A of those cannot be linked with anything. This ends the work
   for nearly all documents, those that merely share a passage included. (The fraction
   falls with the size, and every set sends what the test of its smallest possible partner
   counts, so a partner's shingle is never missed.)
2. The sets that are left, one per group of equal ones, are routed by a pigeonhole: linked
   sets differ in at most D elements, so if hash ranges cut both into P > D parts, at most
   D parts differ. Every set sends the hashes of its first D + 1 non-empty parts: one of
   them must be equal in a linked set. P is the power of two above D of the smaller set; a
   set whose partners could have another P sends keys for both. A set that is too sparse
   for that guarantee sends one extra key shared by all such sets. Sets with a common key
   are joined to the smallest of them (a star, no pairs); connected components of the
   stars are blocks, and links never leave a block.
3. Inside a block the sets lie by size in tiles of about `tile` shingles, and each pair of
   tiles whose sizes can be linked is one group: it builds inverted lists of one tile and
   searches them for each set of the other. For a set of n elements that needs T common
   ones, the T - 1 longest lists are set aside; the short ones are merged by a heap, and
   every set found there is probed by binary search in the long ones, until it reaches T
   or cannot. Sets already in one component are not probed again, so a tile pair reports
   at most one link per set (a spanning forest).
4. Connected components of the links give the answer.

A shingle is a 64-bit hash, equal sets are recognised by a 64-bit fingerprint.

Defined results: null and wordless texts have empty sets and link with nothing; null ids
sort last as component ids (null only if all ids of a component are); repeated rows are in
one component, each with its own row; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .hashing import Substrings, mix
from .store import discard, small, stash, tidy

_C1 = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
TILE = 2_000_000             # shingles, 16 MB


class Shingles:
    """Shingle sets as sorted unique uint64 arrays, straight from a text's UTF-8 bytes."""

    def __init__(self, n: int):
        self.n = n
        self.hashes = Substrings()

    def of(self, text: str | None) -> np.ndarray:
        data = _LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[data], [True]]).astype(np.int8)))
        if not len(edge):
            return np.empty(0, np.uint64)
        start, end = edge[::2], edge[1::2]
        h = mix(self.hashes.between(self.hashes.prefix(data), start, end)
                + (end - start).astype(np.uint64))
        size = min(self.n, len(h))
        out = np.full(len(h) - size + 1, size, np.uint64)
        for k in range(size):
            out = mix(out * _C1 + h[k:k + len(out)])
        out.sort()
        return out[np.concatenate([[True], out[1:] != out[:-1]])]


def set_print(hashes: np.ndarray) -> int:
    """Signed 64-bit fingerprint of a set."""
    value = xxhash.xxh3_64_intdigest(hashes.tobytes())
    return value - (1 << 64) if value >> 63 else value


def max_difference(size: int, num: int, den: int) -> int:
    """Most elements in which a set of `size` elements and a linked set, at least as large,
    can differ: den * i >= num * u with a <= b gives u - i <= a * (den - num) / num."""
    return size * (den - num) // num


def levels(size: int, num: int, den: int) -> range:
    """Exponents of P a set needs: of its own size, and of its smallest partner's."""
    small = -(-size * num // den)
    return range(max_difference(small, num, den).bit_length(),
                 max_difference(size, num, den).bit_length() + 1)


def routing_keys(hashes: np.ndarray, num: int, den: int) -> np.ndarray:
    """The keys of one non-empty set (signed 64-bit)."""
    out = []
    difference = max_difference(len(hashes), num, den)
    mixed = mix(hashes * _C1)
    for level in levels(len(hashes), num, den):
        parts = 1 << level                       # more than the smaller set's difference
        part = hashes >> np.uint64(64 - level) if level else np.zeros(len(hashes), np.uint64)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        send = min(difference, parts - 1) + 1    # non-empty parts: at least one must be equal
        salt = np.uint64(level * 1_000_003)
        out.append(mix(np.add.reduceat(mixed, first)[:send] + salt))
        if len(first) < send:
            out.append(mix(np.array([level * 1_000_003 + 1], np.uint64)))
    return np.concatenate(out).view(np.int64)


def spare(size: int, num: int, den: int) -> int:
    """Most elements of a set of `size` that a linked set may lack."""
    return size - -(-size * num // den)


def _fraction(size: int, num: int, den: int) -> float:
    """Share of its lowest hashes that a set is tested on; falls with the size."""
    share = 1 - num / den
    return min(1.0, 1.1 * share + 2 * math.sqrt(share / size))


def _below(hashes: np.ndarray, fraction: float) -> int:
    return len(hashes) if fraction >= 1 else int(
        np.searchsorted(hashes, np.uint64(int(fraction * (1 << 53)) << 11)))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The sets of a whole batch take several times its texts: a few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _profile(n: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingles(n)
        for batch in _slices(batches):
            sizes, prints, tested, low = [], [], [], []
            for text in batch.column(2):
                h = make.of(text.as_py())
                sizes.append(len(h))
                prints.append(set_print(h) if len(h) else None)
                test = send = 0
                if len(h):
                    test = _below(h, _fraction(len(h), num, den))
                    send = _below(h, _fraction(-(-len(h) * num // den), num, den))
                tested.append(test)
                low.append(h[:send].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()),
                 pa.array(tested, pa.int32()), pa.array(low, pa.list_(pa.int64()))],
                names=["id", "text_key", "size", "set", "tested", "low"])
    return run


def _sets(n: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingles(n)
        for batch in _slices(batches):
            sets = [make.of(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(h) for h in sets], pa.int64()),
                 pa.array([h.tobytes() for h in sets], pa.binary()),
                 pa.array([routing_keys(h, num, den) for h in sets], pa.list_(pa.int64()))],
                names=["set", "size", "hashes", "keys"])
    return run


# --- inside a block -----------------------------------------------------------------

def needed(a: int, b: int, num: int, den: int) -> int:
    """Fewest common elements of linked sets of a and b elements."""
    return -(-num * (a + b) // (num + den))


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


class _Index:
    """Inverted lists as three arrays: token, where its list starts, positions (ascending)."""

    def __init__(self, sets: list[np.ndarray]):
        tokens = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        del order
        start = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])[:len(tokens)])
        self.token, self.start = tokens[start], np.append(start, len(tokens))
        self.owner = array("i", owner.tobytes())

    def lists(self, tokens: np.ndarray) -> list[tuple[int, int]]:
        """(start, end) in `owner` of the tokens' lists, shortest first."""
        at = np.minimum(np.searchsorted(self.token, tokens), max(0, len(self.token) - 1))
        at = at[self.token[at] == tokens] if len(self.token) else at[:0]
        start, end = self.start[at], self.start[at + 1]
        order = np.argsort(end - start, kind="stable")
        return list(zip(start[order].tolist(), end[order].tolist()))


def search(queries: list[np.ndarray], index: list[np.ndarray], num: int, den: int,
           same: bool) -> list[tuple[int, int]]:
    """DivideSkip: links (query, indexed) that join components, a spanning forest of the
    link graph between the two tiles. `same`: both are one tile."""
    place = np.argsort([len(s) for s in index], kind="stable").tolist()
    sizes = [len(index[i]) for i in place]
    inverted = _Index([index[i] for i in place])
    owner = inverted.owner
    forest = Forest(len(index) + (0 if same else len(queries)))
    base = 0 if same else len(index)
    links: list[tuple[int, int]] = []

    def settle(q: int, n: int, at: int, seen: int, long: list[tuple[int, int]]) -> None:
        """Probe the long lists for the set at `at`, found `seen` times in the short ones."""
        if forest.find(base + q) == forest.find(place[at]):
            return
        want, left = needed(n, sizes[at], num, den), len(long)
        for a, b in long:
            if seen >= want or seen + left < want:
                break
            left -= 1
            k = bisect_left(owner, at, a, b)
            seen += k < b and owner[k] == at
        if seen >= want:
            forest.join(base + q, place[at])
            links.append((q, place[at]))

    for q in sorted(range(len(queries)), key=lambda k: len(queries[k])):
        n = len(queries[q])
        low = bisect_left(sizes, -(-n * num // den))
        high = bisect_right(sizes, n * den // num)
        if low >= high:
            continue
        lists = inverted.lists(queries[q])
        least = needed(n, sizes[low], num, den)
        if len(lists) < least:
            continue
        # with T common elements at least one lies outside any T - 1 lists
        short, long = lists[:len(lists) - least + 1], lists[len(lists) - least + 1:]
        last, seen = -1, 0
        for at in heapq.merge(*(owner[bisect_left(owner, low, a, b):bisect_left(owner, high, a, b)]
                                for a, b in short)):
            if at == last:
                seen += 1
                continue
            if last >= 0:
                settle(q, n, last, seen, long)
            last, seen = at, 1
        if last >= 0:
            settle(q, n, last, seen, long)
    return links


def _search_tiles(num: int, den: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        a, b = key[1].as_py(), key[2].as_py()
        tile = np.asarray(table.column("tile"))
        sets = np.asarray(table.column("set"))
        hashes = []
        for chunk in table.column("hashes").chunks:                    # views, no copies
            ends = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset:][:len(chunk) + 1].tolist()
            hashes += [np.frombuffer(chunk.buffers()[2], np.uint64, (end - start) // 8, start)
                       for start, end in zip(ends[:-1], ends[1:])]
        once = np.unique(sets, return_index=True)[1]     # rows repeating (id, text) come again
        left = once[tile[once] == a].tolist()
        right = left if a == b else once[tile[once] == b].tolist()
        found = search([hashes[i] for i in left], [hashes[i] for i in right], num, den, a == b)
        return pa.table({"a": pa.array([int(sets[left[i]]) for i, _ in found], pa.int64()),
                         "b": pa.array([int(sets[right[j]]) for _, j in found], pa.int64())})
    return run


def tile_pairs(blocks: DataFrame, num: int, den: int, tile: int = TILE) -> DataFrame:
    """block, t1, t2, set, tile: the groups each set (block, set, size) takes part in.

    A block's sets lie one after the other by size (equal sizes dealt by hash) and are cut
    every `tile` shingles. A set meets the tiles that hold the sizes a linked set may have,
    from num/den to den/num of its own: it goes to one group for each of them."""
    fine = 1_000_000                             # sizes on a whole-number logarithmic scale
    reach = math.ceil(math.log(den / num) * fine) + 1
    by_size = Window.partitionBy("block").orderBy("size")
    near = Window.partitionBy("block").orderBy((F.log("size") * fine).cast("long"))
    sizes = (blocks.groupBy("block", "size").agg(F.sum("size").alias("n"))
             .withColumn("start", F.sum("n").over(by_size) - F.col("n"))
             .withColumn("low", F.col("start") + F.col("n") - F.sum("n").over(near.rangeBetween(-reach, 0)))
             .withColumn("high", F.col("start") + F.sum("n").over(near.rangeBetween(0, reach)) - 1))

    def cut(place: Column) -> Column:
        return F.floor(place / F.lit(tile)).cast("int")
    m = (blocks.join(sizes, ["block", "size"])
         .withColumn("tile", cut(F.col("start") + F.pmod(F.xxhash64("set"), F.col("n"))))
         .select("block", "set", "tile", F.explode(F.sequence(cut(F.col("low")), cut(F.col("high")))).alias("other")))
    return m.select("block", F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"),
                    "set", "tile")


def block_links(sets: DataFrame, blocks: DataFrame, num: int, den: int, tile: int = TILE) -> DataFrame:
    """a, b: links between the sets (set, size, hashes) of each block (block, set)."""
    sizes = sets.select("set", "size")
    pairs = small(stash(tile_pairs(sizes.join(blocks, "set"), num, den, tile), "tile-pairs"))
    # only this exchange carries the hashes
    return (sets.select("set", "hashes").join(pairs, "set").groupBy("block", "t1", "t2")
            .applyInArrow(_search_tiles(num, den), "a long, b long"))


# --- the join -----------------------------------------------------------------------

def text_key(id_: Column, text: Column) -> Column:
    return F.xxhash64(id_, text)


def linkable(profile: DataFrame, num: int, den: int) -> DataFrame:
    """id, text_key, set of the documents that step 1 cannot rule out."""
    # linked sets are in one size class or in neighbours; class c has bit c modulo 64
    width = math.log(den / num) * 1.001 if den > num else 1.0
    size_class = F.floor(F.log("size") / width)

    def bit(c: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(c, F.lit(64)).cast("int"))
    low = (profile.where("size > 0")
           .select("row", "tested", size_class.alias("c"), F.posexplode("low").alias("at", "shingle")))
    again = (low.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.bit_or(bit(F.col("c"))).alias("classes"))
             .where("n > 1").select("shingle", "classes", (F.col("n") > F.bit_count("classes")).alias("twice")))
    near = F.col("classes").bitwiseAND(bit(F.col("c") - 1).bitwiseOR(bit(F.col("c") + 1))) != 0
    shared = (low.where("at < tested").select("row", "shingle", F.pmod("c", F.lit(64)).cast("tinyint").alias("c"))
              .join(again, "shingle").where(F.col("twice") | near)
              .groupBy("row").agg(F.count(F.lit(1)).alias("shared")))
    lacking = F.col("size") - F.ceil(F.col("size") * F.lit(num) / F.lit(den))
    kept = profile.where("size > 0").join(shared, "row", "left")
    return (kept.where(F.col("tested") - F.coalesce("shared", F.lit(0)) <= lacking)
            .select("id", "text_key", "set"))


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5,
                       num: int = 8, den: int = 10, tile: int = TILE) -> DataFrame:
    """row (unique number), id, text_key, size, set, component (its smallest `set`; null for
    empty sets): one row per document."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.select("id", text_key(F.col("id"), F.col("text")).alias("text_key"), "text")
    wide = stash(rows.mapInArrow(tidy(_profile(n, num, den)), "id long, text_key long, size long, set long, "
                                                              "tested int, low array<long>")
                 .withColumn("row", F.monotonically_increasing_id()), "set-profiles")
    # one text per set; where rows repeat (id, text), the set comes as often as they do
    reps = stash(linkable(wide, num, den).groupBy("set")
                 .agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key")).alias("m"))
                 .select("set", F.col("m.id").alias("r_id"), F.col("m.text_key").alias("r_key")), "linkable")
    profile = stash(wide.drop("tested", "low"), "set-prints")
    discard(wide)
    texts = rows.join(small(reps), (F.col("text_key") == F.col("r_key"))
                      & F.col("id").eqNullSafe(F.col("r_id")))
    sets = stash(texts.select("set", "text").mapInArrow(
        tidy(_sets(n, num, den)), "set long, size long, hashes binary, keys array<long>"), "sets")
    keyed = sets.select("set", F.explode("keys").alias("key"))
    shared = (keyed.groupBy("key").agg(F.min("set").alias("first"), F.max("set").alias("last"))
              .where("first < last").select("key", "first"))
    stars = stash(keyed.join(shared, "key").where("set <> first").select("set", "first").distinct(), "stars")
    blocks = components(stars, "set", "first").select(F.col("node").alias("set"), F.col("root").alias("block"))
    links = components(block_links(sets, blocks, num, den, tile))
    found = stash(links.select(F.col("node").alias("set"), F.col("root").alias("component")), "set-components")
    for t in (stars, sets, reps):
        discard(t)
    return (profile.join(found, "set", "left")
            .select("row", "id", "text_key", "size", "set", F.coalesce("component", "set").alias("component")))


def component_ids(similar: DataFrame) -> DataFrame:
    """Adds component_id, the smallest id of the component (empty sets: their own id)."""
    least = (similar.where(F.col("component").isNotNull()).groupBy("component")
             .agg(F.min("id").alias("least")))
    return similar.join(least, "component", "left").withColumn(
        "component_id", F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("least")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5,
             num: int = 8, den: int = 10, tile: int = TILE) -> DataFrame:
    """The documents with one left of each component: the smallest id (of rows that repeat
    it, one). Documents without words all stay. All columns are kept."""
    similar = stash(similar_components(docs, id_col, text_col, n, num, den, tile), "similar")
    best = (similar.where(F.col("component").isNotNull()).groupBy("component")
            .agg(F.count(F.lit(1)).alias("copies"),
                 F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key", "row")).alias("m"))
            .where("copies > 1").select("component", F.col("m.row").alias("best")))
    # what goes: per (id, text) so many rows as are not the best; repeated rows differ only by number
    gone = (similar.join(best, "component").where("row <> best").groupBy("id", "text_key")
            .agg(F.count(F.lit(1)).alias("drop")))
    held = similar.groupBy("id", "text_key").agg(F.count(F.lit(1)).alias("all"))
    gone = stash(gone.alias("g").join(held.alias("h"), F.col("g.id").eqNullSafe(F.col("h.id"))
                                      & F.col("g.text_key").eqNullSafe(F.col("h.text_key")))
                 .select("g.id", "g.text_key", "drop", "all"), "dropped")
    rows = docs.select(F.struct("*").alias("doc"), F.col(id_col).cast("long").alias("id_"), F.col(text_col).alias("t_"))
    rows = rows.withColumn("key_", text_key(F.col("id_"), F.col("t_")))
    marked = rows.join(small(gone), F.col("id_").eqNullSafe(F.col("id")) & (F.col("key_") == F.col("text_key")), "left")
    left = marked.where(F.col("drop").isNull()).select("doc.*")
    if gone.where("drop < all").isEmpty():
        return left
    # some of several equal rows stay: they are equal in (id, text), one of them does
    some = marked.where("drop < all").dropDuplicates(["id_", "key_"])
    return left.unionByName(some.select("doc.*"))
