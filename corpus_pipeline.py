"""The corpus pipeline: quality, lines, near duplicates, benchmark leaks, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `docs` is what the stage
before it wrote. All stages but the last return the columns of `documents` (more columns
of `docs` are dropped by the first stage).

Defined results, beside those of the operators: a missing `labels` row trains nothing;
texts the line stage empties stay as documents; documents without words are nobody's
near duplicates; n_chars follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telespark.llm import decontaminate, factorisation, jaccard_join, line_dedup, packing
from telespark.llm.store import stash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    model = factorisation.train_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = factorisation.score(docs, model, keep=[F.col(c) for c in COLUMNS])
    return scored.where(F.col("score") >= factorisation.THRESHOLD).select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each source go."""
    out = line_dedup.drop_lines(docs.select(*COLUMNS), "source")
    text = F.col("line_dedup.text")
    n_chars = F.when(F.col("line_dedup.n_dropped") > 0, F.length(text).cast("long")).otherwise(F.col("row.n_chars"))
    return out.select("row.doc_id", text.alias("text"), "row.lang", "row.source", n_chars.alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8 or more stays."""
    return jaccard_join.keep_one(docs.select(*COLUMNS), n=5, num=8, den=10)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return decontaminate.decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document's pieces in sequences of at most 2,048 tokens."""
    return packing.pack(docs).drop("ids")


STAGES = [("quality_classifier", quality), ("line_dedup", lines), ("ngram_jaccard_join", near_duplicates),
          ("benchmark_decontamination", benchmark_leaks), ("best_fit_packing", pack)]

# the classifier, the search and the packing have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs
