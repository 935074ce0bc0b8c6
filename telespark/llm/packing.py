"""Packing tokenised documents into sequences by minimum bin slack.

A document is its byte-level BPE ids plus id 0. Longer ones are cut into pieces of
`capacity` tokens, the first piece may be shorter. The pieces are described completely
by a histogram of at most `capacity` lengths, so the packing is planned on that: the
largest length left opens a bin, a bitset subset-sum dynamic program over the lengths
still available finds the fullest feasible filling, and the combination is removed as
many times as the stock allows. Each combination uses up at least one length, so there
are never more than `capacity` of them, however many documents there are.

Every piece then finds its place from its rank among the pieces of its length: a rank
is the rows of that length in earlier partitions of the stored table plus the place
inside its own partition, so a length that a third of all pieces share is ranked by
many tasks.

Defined results: null text counts as empty (one piece, the id 0); null ids and repeated
rows are separate documents; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import held, stash, tidy

# pre-tokenisation of the byte-level BPE vocabulary (fixed value of that file format)
PIECE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# the same for texts of characters up to here, for the standard engine, which is faster
# but has no classes by category; other texts take the plain way
_LAST_SIMPLE = 0x24F
CACHE_WORDS = 800_000
JOINED = 64
GROUP_CHARS = 200_000
_END = (0).to_bytes(4, "little")


def _class(test) -> str:
    """Ranges of a character class up to _LAST_SIMPLE."""
    codes = [c for c in range(_LAST_SIMPLE + 1) if test(chr(c))]
    starts = [c for c in codes if c - 1 not in codes]
    ends = [c for c in codes if c + 1 not in codes]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends))


def simple_pattern() -> re.Pattern:
    letter = _class(lambda c: unicodedata.category(c)[0] == "L")
    number = _class(lambda c: unicodedata.category(c)[0] == "N")
    space = _class(lambda c: c in "\t\n\v\f\r \x85\xa0")
    return re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+"
                      rf"|[{space}]+(?![^{space}])|[{space}]+")


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids as little-endian bytes. Pieces of the pre-tokeniser are encoded on their
    own and remembered; the ids of a text are their concatenation. The memory has two
    generations of at most CACHE_WORDS / 2 pieces: a full one becomes the old one, and
    what is met again comes back from there, so that frequent pieces stay."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"   # Spark's tasks fill the cores
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces = simple_pattern().findall
        self.odd = re.compile(f"[^\\x00-\\u{_LAST_SIMPLE:04x}]").search
        vocabulary = self.tokenizer.get_vocab()
        self.token_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, k in vocabulary.items():
            self.token_bytes[k] = len(token)             # a character stands for a byte
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _plain(self, texts: list[str]) -> list[bytes]:
        done = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in done]

    def _learn(self, words: set[str]) -> None:
        new = words.difference(self.known)
        if new and len(self.known) > CACHE_WORDS // 2:
            self.old, self.known = self.known, {}
            new = words
        old = self.old
        self.known.update([(w, old[w]) for w in new if w in old])
        rest = [w for w in new if w not in old]
        # a space and letters: such pieces stay pieces when they are joined
        plain = [w for w in rest if w[0] == " " and w[1:].isalpha()]
        self.known.update(zip(plain, self._joined(plain)))
        other = [w for w in rest if w not in self.known]
        self.known.update(zip(other, self._plain(other)))

    def _joined(self, words: list[str]) -> list[bytes]:
        """The ids of pieces that are cheaper to encode JOINED at a time: a piece ends where
        the bytes of the tokens reach its own end."""
        texts = ["".join(words[k:k + JOINED]) for k in range(0, len(words), JOINED)]
        every = array("I")
        for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            every.extend(e.ids)
        reached = np.cumsum(self.token_bytes[np.frombuffer(every, np.uint32)])
        ends = np.cumsum(np.fromiter((len(w.encode()) for w in words), np.int64, len(words)))
        last = np.searchsorted(reached, ends)
        if len(words) and not (reached[-1] == ends[-1] and np.array_equal(reached[last], ends)):
            return self._plain(words)
        data, stops = every.tobytes(), (4 * (last + 1)).tolist()
        return [data[a:b] for a, b in zip([0, *stops], stops)]

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of every text, in order. Texts of GROUP_CHARS characters in all are cut
        into pieces before their new pieces are encoded, all at once."""
        group, chars = [], 0
        for text in texts:
            group.append(text)
            chars += len(text)
            if chars >= GROUP_CHARS:
                yield from self._group(group)
                group, chars = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        cuts = [None if self.odd(t) or any(s in t for s in self.special) else self.pieces(t) for t in texts]
        self._learn(set().union(*filter(None, cuts)))
        get = self.known.__getitem__
        for text, words in zip(texts, cuts):
            yield self._plain([text])[0] if words is None else b"".join(map(get, words))

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens; only the first is short."""
    first = (n - 1) % capacity + 1
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def _tokenise(path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held(f"encoder {path}", lambda: Encoder(path))
        for batch in batches:
            out = {k: [] for k in ("id", "piece", "start", "length", "ids_crc32", "ids")}
            texts = (text.as_py() or "" for text in batch.column(1))
            for id_, ids in zip(batch.column(0).to_pylist(), encoder.encode_all(texts)):
                data = ids + _END
                for i, (start, length) in enumerate(cut(len(data) // 4, capacity)):
                    part = data[4 * start:4 * (start + length)]
                    out["id"].append(id_)
                    out["piece"].append(i)
                    out["start"].append(start)
                    out["length"].append(length)
                    out["ids_crc32"].append(zlib.crc32(part))
                    out["ids"].append(np.frombuffer(part, "<u4").astype(np.int32) if with_ids else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["id"], pa.int64()), pa.array(out["piece"], pa.int32()),
                 pa.array(out["start"], pa.int64()), pa.array(out["length"], pa.int64()),
                 pa.array(out["ids_crc32"], pa.int64()), pa.array(out["ids"], pa.list_(pa.int32()))],
                names=list(out))
    return run


_PIECES = "id long, piece int, start long, length long, ids_crc32 long, ids array<int>"


def plan(stock: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Minimum bin slack over a histogram: [(combination [(length, times)], bins)].

    The sums that i lengths can reach are one Python integer, bit s for sum s; a length
    that is there k times is added in doubling steps. Walking the integers backwards
    from the highest bit gives the combination.
    """
    stock = {length: n for length, n in stock.items() if n > 0}
    mask = (1 << (capacity + 1)) - 1
    out = []
    while stock:
        top = max(stock)
        room = capacity - top
        rest = sorted((length for length in stock if length <= room), reverse=True)
        reach, steps = 1, []
        goal = 1 << room
        for length in rest:
            times = min(stock[length] - (length == top), room // length)
            k = 1
            while times > 0:
                k = min(k, times)
                steps.append((length, k, reach))
                reach |= (reach << (length * k)) & mask
                times -= k
                k *= 2
            if reach & goal:
                break
        best = (reach & ((1 << (room + 1)) - 1)).bit_length() - 1
        use = {top: 1}
        for length, k, before in reversed(steps):
            if not before >> best & 1:
                use[length] = use.get(length, 0) + k
                best -= length * k
        bins = min(stock[length] // n for length, n in use.items())
        out.append((sorted(use.items(), reverse=True), bins))
        for length, n in use.items():
            stock[length] -= n * bins
            if not stock[length]:
                del stock[length]
    return out


def _places(combinations) -> np.ndarray:
    """(length, first rank, first sequence, times per bin, offset): one row per
    combination and length, by length and rank."""
    rows, given, sequence = [], {}, 0
    for use, bins in combinations:
        offset = 0
        for length, times in use:
            rows.append((length, given.get(length, 0), sequence, times, offset))
            given[length] = given.get(length, 0) + times * bins
            offset += length * times
        sequence += bins
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def _assign(places: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rank < 2^47 and length < 2^16 share one sortable integer
        keys = (places[:, 0] << 47) + places[:, 1]
        for batch in batches:
            length = np.asarray(batch.column("length"), np.int64)
            rank = np.asarray(batch.column("rank"), np.int64)
            row = places[np.searchsorted(keys, (length << 47) + rank, side="right") - 1]
            bin_, slot = np.divmod(rank - row[:, 1], row[:, 3])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in ("id", "piece", "start", "length", "ids_crc32", "ids")),
                 pa.array(row[:, 2] + bin_), pa.array(row[:, 4] + slot * length)],
                names=["id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"])
    return run


def ranked(pieces: DataFrame) -> DataFrame:
    """Adds `rank`, gapless from 0 among the pieces of one length (the stored table has
    `part`, the partition that wrote the row, and `row`, unique)."""
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "part").orderBy("row")
    local = pieces.withColumn("local", F.row_number().over(inside) - 1)
    return local.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("local"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048,
         tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, ids (if asked for),
    sequence_id, offset."""
    path = tokenizer or default_tokenizer()
    pieces = stash(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
                   .mapInArrow(tidy(_tokenise(path, capacity, with_ids), f"encoder {path}"), _PIECES)
                   .withColumn("part", F.spark_partition_id())
                   .withColumn("row", F.monotonically_increasing_id()), "pieces")
    # at most `capacity` rows
    stock = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = _places(plan(stock, capacity))
    return (ranked(pieces).select("id", "piece", "start", "length", "ids_crc32", "ids", "rank")
            .mapInArrow(tidy(_assign(places)), _PIECES + ", sequence_id long, offset long")
            .withColumnRenamed("id", id_col))
