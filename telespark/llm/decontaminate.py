"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Texts are cut into lower-cased words (letters and digits); in scripts written without
spaces (Chinese, Japanese, Thai, Lao, Khmer, Burmese and others) every character is a
word. A seed is the hash of the
words at a mask's positions; the words between do not matter, so a substitution there
does not hide the seed. The two masks below (weight 5, span 7) together hit every
12-word window with up to two substituted words, wherever these are (a test goes through
all cases). Seeds of all benchmark items are joined with the seeds at every position of
every document. A hit fixes a diagonal (document position minus item position); around
each hit the whole diagonal is compared word by word, and a document is contaminated by
an item if some `WINDOW` aligned words agree in at least 80 %.

The seed table of the benchmark is broadcast only up to BROADCAST_SEEDS rows (32 bytes
each); a larger benchmark is joined by shuffling the document seeds on their hash.
Documents never shuffle in the first case: only hits do.

Items of fewer than `WINDOW` words are searched exactly: the hash of the item's whole word
sequence is joined with the hashes of the documents' windows of as many words (only of the
lengths that the benchmark has), and the words are compared. There is no least length: an
item of one word contaminates every document with that word.

Defined results: null or wordless texts contaminate nothing and are clean; null ids are ids of their own, rows with one doc_id are reported together; repeated items
are reported by each id; empty tables give no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import small, stash

WINDOW = 12
MIN_SHARE = 0.8
MASKS = ((0, 1, 2, 5, 6), (0, 2, 4, 5, 6))
SPAN = 7
# blocks of scripts without spaces between words, for a regular expression's brackets
UNSPACED = (r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u1950-\u19FF\u1A20-\u1AAF\u1B00-\u1B7F"
            r"\u3005-\u3007\u3040-\u312F\u31A0-\u31BF\u31F0-\u31FF\u3400-\u4DBF\u4E00-\u9FFF\uA000-\uA4CF"
            r"\uA980-\uA9FF\uAA60-\uAADF\uF900-\uFAFF\uFF66-\uFF9F\x{1AFF0}-\x{1B16F}\x{20000}-\x{3FFFF}")
BROADCAST_SEEDS = 1_000_000


def words(text: Column) -> Column:
    # one cheap look first: most texts have no character of these scripts
    text = F.when(text.rlike(r"[\u0E00-\x{10FFFF}]"),
                  F.regexp_replace(text, f"([{UNSPACED}])", " $1 ")).otherwise(text)
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _seeds(df: DataFrame, hashes: str, at: str) -> DataFrame:
    """One row per position and mask: `seed`; positions start at 0."""
    starts = F.when(F.size(hashes) >= SPAN, F.sequence(F.lit(0), F.size(hashes) - SPAN))
    rows = df.select("*", F.explode(starts).alias(at))
    # the first value of the hash is the mask's number, so masks never meet
    each = [F.xxhash64(F.lit(m), *(F.get(F.col(hashes), F.col(at) + o) for o in mask))
            for m, mask in enumerate(MASKS)]
    return rows.select("*", F.explode(F.array(*each)).alias("seed"))


def _best_window(same: Column) -> Column:
    """Most agreeing words in any WINDOW consecutive ones of array<int> `same`."""
    starts = F.sequence(F.lit(0), F.size(same) - WINDOW)
    sums = F.transform(starts, lambda s: F.aggregate(F.slice(same, s + 1, F.lit(WINDOW)), F.lit(0),
                                                     lambda a, x: a + x))
    return F.when(F.size(same) >= WINDOW, F.array_max(sums)).otherwise(F.lit(0))


def _sequence(hashes: Column) -> Column:
    return F.xxhash64(F.size(hashes), hashes)


def _short_hits(d: DataFrame, items: DataFrame, broadcast_rows: int) -> DataFrame | None:
    """doc, text_key, item, best, at: the places of the items of fewer than WINDOW words;
    None if there are no such items."""
    short = items.where(F.size("item_words") < WINDOW).select(
        "item", "item_words", _sequence(F.col("item_words")).alias("sequence"))
    lengths = [r[0] for r in short.select(F.size("item_words")).distinct().collect()]   # below WINDOW
    if not lengths:
        return None
    few = short.count() <= broadcast_rows
    rows = d.where(F.size("hashes") >= min(lengths)).select(
        "*", F.explode(F.sequence(F.lit(0), F.size("hashes") - min(lengths))).alias("at"))
    windows = F.array(*(F.slice("hashes", F.col("at") + 1, n) for n in lengths))
    # at the end of a text the longer ones are cut off: those are shorter windows
    rows = rows.select("doc", "text_key", "at", F.explode(F.array_distinct(windows)).alias("window"))
    hits = rows.withColumn("sequence", _sequence(F.col("window"))).join(
        F.broadcast(short) if few else short, "sequence")
    return hits.where(F.col("window") == F.col("item_words")).select(
        "doc", "text_key", "item", F.size("window").alias("best"), "at")


def contaminations(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id",
                   text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
                   broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """doc, text_key, item, best (agreeing words in the best window; of an
    item of fewer than WINDOW words, all its words), start (word where the best diagonal
    begins in the document): one row per document text and item."""
    every = stash(benchmark.select(F.col(item_id).alias("item"),
                                   _word_hashes(F.col(item_text)).alias("item_words"))
                  .where(F.size("item_words") > 0)
                  .withColumn("item_row", F.monotonically_increasing_id()), "benchmark-items")
    items = every.where(F.size("item_words") >= WINDOW)
    seeds = stash(_seeds(items, "item_words", "item_at")
                  .select("seed", "item_row", "item_at", F.size("item_words").alias("item_n")),
                  "benchmark-seeds")
    small = seeds.count() <= broadcast_seeds
    d = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(text_col).alias("text_key"),
                    _word_hashes(F.col(text_col)).alias("hashes"))
    hits = _seeds(d, "hashes", "at").join(F.broadcast(seeds) if small else seeds, "seed")
    diagonal = F.col("at") - F.col("item_at")
    lead = F.greatest(F.lit(0), -diagonal)          # item words before the document's first
    stretch = F.slice("hashes", F.greatest(F.lit(0), diagonal) + 1, F.col("item_n") - lead)
    hits = hits.select("doc", "text_key", "item_row", diagonal.alias("diagonal"),
                       lead.alias("lead"), stretch.alias("stretch"))
    hits = hits.dropDuplicates(["doc", "text_key", "item_row", "diagonal"])
    j = hits.join(F.broadcast(items) if small else items, "item_row")
    other = F.slice("item_words", F.col("lead") + 1, F.size("stretch"))
    j = j.withColumn("same", F.zip_with("stretch", other, lambda a, b: F.when(a == b, 1).otherwise(0)))
    j = j.withColumn("best", _best_window(F.col("same")))
    need = -int(-MIN_SHARE * WINDOW // 1)
    found = j.where(F.col("best") >= need).select(
        "doc", "text_key", "item", "best", F.greatest(F.lit(0), F.col("diagonal")).alias("at"))
    short = _short_hits(d, every, broadcast_seeds)
    if short is not None:
        found = found.unionByName(short)
    return (found.groupBy("doc", "text_key", "item")
            .agg(F.max(F.struct("best", -F.col("at"))).alias("m"))
            .select("doc", "text_key", "item", F.col("m.best").alias("best"), (-F.col("m.col2")).alias("start")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """The documents that no item contaminates, all columns kept."""
    bad = stash(contaminations(docs, benchmark, doc_id, text_col).select("doc", "text_key").distinct(),
                "contaminated")
    rows = docs.select(F.struct("*").alias("row"))
    clean = rows.join(small(bad), F.col(f"row.{doc_id}").eqNullSafe(F.col("doc"))
                      & (F.xxhash64(f"row.{text_col}") == F.col("text_key")), "left_anti")
    return clean.select("row.*")
