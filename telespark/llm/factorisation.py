"""Quality classifier: a factorisation machine on hashed words, structure and metadata.

A document becomes a sparse vector: hashed words (log-scaled counts, unit length),
structure statistics (shares of repeated words and lines, symbols, capitals and digits,
lengths) cut into steps, and the declared length as metadata.
Labels, language, source and id are never read by the scoring. The score is

    w0 + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]

through the logistic function: the pairwise term by the sum-of-squares identity, linear
in the number of features.

The model is fitted on at most `max_rows` labelled rows (those with the smallest hash of
their id; a parameter), by Adagrad on the driver over their sparse vectors; the vectors
are made by Spark tasks. Scoring goes over every whole text in the tasks; the model
(0.6 MB) travels with the function.

Defined results: null text counts as empty and is scored like every other; null n_chars
is a step of its own; without two classes among the training rows every score is the
share of label 1 (0.5 without any rows); repeated rows get equal scores; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import tidy

WORD_SLOTS = 1 << 14
STEPS = 8                    # steps of a structure statistic
FACTORS = 8
MAX_TRAIN_ROWS = 6_000
THRESHOLD = 0.3
_KNOWN_WORDS = 100_000

# upper ends of the steps, one row per statistic (parameters of the features)
STATISTICS = {
    "words": (1, 10, 30, 100, 300, 1000, 3000),
    "mean_word": (2, 3, 4, 5, 6, 8, 12),
    "distinct_share": (.02, .05, .1, .2, .4, .6, .8),
    "top_word_share": (.03, .06, .1, .15, .25, .4, .7),
    "adjacent_repeat_share": (.005, .02, .05, .1, .2, .4, .7),
    "symbol_share": (.005, .02, .04, .06, .1, .2, .4),
    "capital_share": (.005, .02, .04, .08, .15, .3, .6),
    "digit_share": (.001, .005, .02, .05, .1, .2, .4),
    "bare_symbol_words": (.005, .02, .05, .1, .2, .4, .7),
    "repeated_line_share": (.01, .05, .1, .2, .3, .5, .8),
    "mean_line": (10, 30, 60, 120, 250, 500, 1000),
    "sentence_ends": (.005, .02, .05, .08, .12, .2, .4),
    "declared_length": (0, 50, 200, 1000, 3000, 10_000, 30_000),
}
_NAMES = tuple(STATISTICS)
# hashed words, then the steps of each statistic (one more for a missing value)
SIZE = WORD_SLOTS + len(_NAMES) * (STEPS + 1)


def statistics(text: str, words: list[str], counts: Counter, n_chars: int | None) -> list[float | None]:
    n, size = max(1, len(words)), max(1, len(text))
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    bare = sum(c for w, c in counts.items() if not any(map(str.isalnum, w)))
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    kinds = Counter(text)
    capital = sum(c for k, c in kinds.items() if k.isupper())
    digit = sum(c for k, c in kinds.items() if k.isdigit())
    plain = sum(c for k, c in kinds.items() if k.isalnum() or k.isspace())
    ends = sum(kinds[k] for k in ".!?")
    return [len(words), (size - kinds[" "]) / n, len(counts) / n,
            max(counts.values(), default=0) / n, repeats / n,
            (len(text) - plain) / size, capital / size, digit / size, bare / n,
            1 - len(set(lines)) / max(1, len(lines)), size / max(1, len(lines)), ends / n, n_chars]


class Features:
    """Sparse vectors; remembers the slots of the words it has seen (bounded)."""

    def __init__(self):
        self.slots: dict[str, int] = {}

    def of(self, text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
        text = text or ""
        words = text.split()
        counts = Counter(words)
        slots = self.slots
        if len(slots) > _KNOWN_WORDS:
            slots.clear()
        for w in counts:
            if w not in slots:
                slots[w] = zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) % WORD_SLOTS
        slot = np.fromiter(map(slots.__getitem__, counts), np.int64, len(counts))
        value = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
        index, where = np.unique(slot, return_inverse=True)
        x = np.bincount(where, value, len(index)) if len(index) else np.zeros(0)
        norm = math.sqrt(float(x @ x)) or 1.0
        stats = statistics(text, words, counts, n_chars)
        steps = [WORD_SLOTS + k * (STEPS + 1) + (STEPS if s is None else
                 int(np.searchsorted(STATISTICS[_NAMES[k]], s, side="right")))
                 for k, s in enumerate(stats)]
        return (np.concatenate([index, np.array(steps, np.int64)]),
                np.concatenate([x / norm, np.ones(len(steps))]))


@dataclass
class Model:
    """bias, w (SIZE), v (SIZE x FACTORS); `constant` where nothing could be learnt."""
    bias: float
    w: np.ndarray
    v: np.ndarray
    constant: float | None = None

    def raw(self, index: np.ndarray, x: np.ndarray) -> float:
        v = self.v[index]
        s = x @ v
        pairs = 0.5 * float(s @ s - (x * x) @ (v * v).sum(axis=1))
        return float(self.bias + self.w[index] @ x + pairs)

    def score(self, index: np.ndarray, x: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, self.raw(index, x)))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 6, rate: float = 0.1,
        decay: float = 1e-5, seed: int = 7) -> Model:
    """Adagrad over single rows in a seeded order."""
    rng = np.random.default_rng(seed)
    model = Model(0.0, np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, FACTORS)))
    ones = sum(y for _, _, y in rows)
    if not rows or ones in (0, len(rows)):
        model.constant = ones / len(rows) if rows else 0.5
        return model
    model.bias = math.log(ones / (len(rows) - ones))
    # both classes weigh the same in sum, whatever their shares
    weight = {1: len(rows) / (2 * ones), 0: len(rows) / (2 * (len(rows) - ones))}
    g_bias, g_w, g_v = 1e-8, np.full(SIZE, 1e-8), np.full((SIZE, FACTORS), 1e-8)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            index, x, y = rows[k]
            v = model.v[index]
            s = x @ v
            raw = model.bias + model.w[index] @ x + 0.5 * (s @ s - (x * x) @ (v * v).sum(axis=1))
            error = (1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, raw)))) - y) * weight[y]
            d_w = error * x + decay * model.w[index]
            d_v = error * (x[:, None] * s - v * (x * x)[:, None]) + decay * v
            g_bias += error * error
            model.bias -= rate * error / math.sqrt(g_bias)
            g_w[index] += d_w * d_w
            model.w[index] -= rate * d_w / np.sqrt(g_w[index])
            g_v[index] += d_v * d_v
            model.v[index] -= 0.3 * rate * d_v / np.sqrt(g_v[index])
    return model


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = Features()
    for batch in batches:
        out = [features.of(t.as_py(), n) for t, n in zip(batch.column(0), batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [pa.array([a.astype(np.int32) for a, _ in out], pa.list_(pa.int32())),
             pa.array([b.astype(np.float32) for _, b in out], pa.list_(pa.float32())), batch.column(2)],
            names=["i", "x", "y"])


def train(labelled: DataFrame, text_col: str = "text", chars_col: str = "n_chars",
          label_col: str = "quality", order_col: str = "doc_id",
          max_rows: int = MAX_TRAIN_ROWS) -> Model:
    """Fit on at most `max_rows` rows of `labelled`, in the order of a hash of `order_col`."""
    some = (labelled.where(F.col(label_col).isin(0, 1))
            .select(F.col(text_col).alias("t"), F.col(chars_col).cast("long").alias("n"),
                    F.col(label_col).cast("int").alias("y"), F.xxhash64(order_col).alias("o"))
            .orderBy("o", "t", "y").limit(max_rows))
    rows = some.select("t", "n", "y").mapInArrow(tidy(_vectors), "i array<int>, x array<float>, y int").toArrow()
    return fit([(np.asarray(i, np.int64), np.asarray(x, np.float64), y) for i, x, y in
                zip(rows["i"].to_pylist(), rows["x"].to_pylist(), rows["y"].to_pylist())])


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            scores = [model.score(*features.of(t.as_py(), n))
                      for t, n in zip(batch.column(1), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64())], names=["row", "score"])
    return run


def score(docs: DataFrame, model: Model, keep: list[Column] | None = None, text_col: str = "text",
          chars_col: str = "n_chars") -> DataFrame:
    """row (struct of the columns in `keep`; all by default), score."""
    model = Model(model.bias, model.w.astype(np.float32), model.v.astype(np.float32), model.constant)
    rows = docs.select(F.struct(*(keep or ["*"])).alias("row"), F.col(text_col).alias("t"),
                       F.col(chars_col).cast("long").alias("n"))
    schema = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(tidy(_score(model)), schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows never learnt from: crc32 of the id as text is a multiple of 5."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train_on(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> Model:
    """Fit on the labelled documents outside the held-out fold. Only ids are joined with
    the labels before the bound; the texts of at most `max_rows` rows follow."""
    lab = (labels.where(F.col("quality").isin(0, 1) & ~held_out("doc_id"))
           .select(F.col("doc_id").alias("lab_id"), F.col("quality").alias("lab_quality")))
    ids = docs.select(F.col("doc_id").alias("lab_id")).join(lab, "lab_id")
    some = (ids.orderBy(F.xxhash64("lab_id"), "lab_id", "lab_quality").limit(max_rows).distinct())
    rows = docs.select("doc_id", "text", "n_chars").join(
        F.broadcast(some), F.col("doc_id") == F.col("lab_id"))
    return train(rows, label_col="lab_quality", max_rows=max_rows)
