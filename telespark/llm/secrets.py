"""Secret scan with an incremental blob ledger, in DataFrame functions only.

Every historical version of every path is content-addressed: its blob is the SHA-256 of
its text. The ledger is a table of (blob, rule, rule_version, spans), one row per pair
that has been scanned, with findings or without. A scan looks up which (blob, rule
version) pairs of the given versions the ledger lacks, scans only those, each blob once
however many versions share it, and appends them. Findings are joined back to all paths.
Only ledger rows of the given blobs are grouped, however long the ledger is. A pair that
was appended twice (by two drivers at once, or a repeated update) counts once.

The positions of all matches come from two functions: `regexp_extract_all` gives the
matches, `split` by the same pattern the text between them; running sums of both lengths
are the starts (in code points).

Rules (name, version, pattern, group, least length of the group): the pattern is matched
leftmost and non-overlapping, then matches with a too short group are dropped. For the
runs `AKIA[A-Z0-9]+` and `[0-9a-f]+` the least length is part of the pattern: a match is
always a whole run there, so dropping short ones before or after is the same.

Defined results: null text counts as empty; paths may be null and may repeat, every
version row gets its own result row; blobs without findings give an empty list; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import folder, stash


@dataclass(frozen=True)
class Rule:
    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    # a match holds one of these, in any case; texts without them are not searched
    words: tuple[str, ...] = ()


# fixed values: the base rules in their fixed order
RULES = (
    Rule("assign", 1,
         r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         2, 6, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", words=("akia",)),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)

_LEDGER = ("blob string, rule string, rule_version int, "
           "spans array<struct<start:int, `end`:int>>")


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def match_spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of the rule's matches in a non-null text."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    part = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    between = F.split(text, rule.pattern, -1)
    rows = F.transform(F.arrays_zip(F.slice(between, F.lit(1), F.size(whole)).alias("b"),
                                    whole.alias("w"), part.alias("p")),
                       lambda z: F.struct(F.length(z["b"]).alias("b"), F.length(z["w"]).alias("w"),
                                          F.length(z["p"]).alias("p")))
    zero = F.struct(F.lit(0).alias("at"),
                    F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc, z):
        start = acc["at"] + z["b"]
        end = start + z["w"]
        one = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"),
                        F.when(z["p"] >= rule.least, F.concat(acc["out"], one))
                        .otherwise(acc["out"]).alias("out"))

    spans = F.aggregate(rows, zero, step, lambda acc: acc["out"])
    none = F.array().cast("array<struct<start:int,end:int>>")
    found = F.when(F.size(whole) > 0, spans).otherwise(none)
    if rule.words:
        lower = F.lower(text)
        may = F.lit(False)
        for word in rule.words:
            may = may | F.contains(lower, F.lit(word))
        found = F.when(may, found).otherwise(none)
    return found


def versions_of(docs: DataFrame, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """path, blob, text: every row is one historical version of its path."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(path_col).alias("path"), blob_id(text).alias("blob"), text.alias("text"))


def open_ledger(spark: SparkSession, path: str | None) -> DataFrame:
    """The ledger's rows; an empty one where nothing has been written yet."""
    if path is None:
        return spark.createDataFrame([], _LEDGER)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], _LEDGER)
    return spark.read.schema(_LEDGER).parquet(path)


def scan_unseen(versions: DataFrame, ledger: DataFrame, rules=RULES) -> DataFrame:
    """New ledger rows for the (blob, rule version) pairs the ledger lacks."""
    wanted = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("rule_version"))
                       for r in rules))
    # one version per blob: the smallest path (paths that repeat are scanned again, then dropped)
    one = versions.groupBy("blob").agg(F.min("path").alias("path"))
    seen = (ledger.join(one.select("blob"), "blob", "left_semi").groupBy("blob")
            .agg(F.collect_set(F.struct("rule", "rule_version")).alias("seen")))
    todo = (one.join(seen, "blob", "left")
            .withColumn("todo", F.array_except(wanted, F.coalesce("seen", F.array().cast(
                "array<struct<rule:string,rule_version:int>>"))))
            .where(F.size("todo") > 0).select("blob", "path", "todo"))
    v, t = versions.alias("v"), todo.alias("t").hint("shuffle_hash")
    texts = v.join(t, (F.col("v.blob") == F.col("t.blob")) & F.col("v.path").eqNullSafe(F.col("t.path")))
    found = F.array(*(
        F.when(F.array_contains("t.todo", F.struct(F.lit(r.name).alias("rule"),
                                                   F.lit(r.version).alias("rule_version"))),
               F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("rule_version"),
                        match_spans(F.col("v.text"), r).alias("spans")))
        for r in rules))
    rows = texts.select(F.col("v.blob").alias("blob"),
                        F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x"))
    return (rows.select("blob", "x.rule", "x.rule_version", "x.spans")
            .dropDuplicates(["blob", "rule", "rule_version"]))


def update_ledger(docs: DataFrame, path: str, rules=RULES, path_col: str = "doc_id",
                  text_col: str = "text") -> int:
    """Scan what the ledger at `path` lacks and append it; returns the rows added."""
    spark = docs.sparkSession
    new = stash(scan_unseen(versions_of(docs, path_col, text_col), open_ledger(spark, path), rules),
                "ledger-new")
    new.write.mode("append").parquet(path)
    return new.count()


def findings(docs: DataFrame, ledger: DataFrame, rules=RULES, path_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """path, blob, findings (array of kind, start, end by start and rule order): one row
    per version. Equal spans of a kind are one, so rows the ledger holds twice add nothing."""
    order = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))))
    current = F.lit(False)
    for r in rules:
        current = current | ((F.col("rule") == r.name) & (F.col("rule_version") == r.version))
    per_blob = (ledger.where(current & (F.size("spans") > 0))
                .select("blob", "rule", F.explode("spans").alias("s"))
                .groupBy("blob").agg(F.array_sort(F.collect_set(F.struct(
                    F.col("s.start").alias("start"), order[F.col("rule")].alias("rank"),
                    F.col("s.end").alias("end"), F.col("rule").alias("kind")))).alias("findings")))
    index = versions_of(docs, path_col, text_col).select("path", "blob")
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    return index.join(per_blob, "blob", "left").select(
        "path", "blob", F.coalesce("findings", none).alias("findings"))


def scan(docs: DataFrame, rules=RULES, ledger_path: str | None = None, path_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Bring the ledger up to date (a fresh one by default) and join it to all paths."""
    spark = docs.sparkSession
    path = ledger_path or folder(spark, "ledger")
    update_ledger(docs, path, rules, path_col, text_col)
    return findings(docs, open_ledger(spark, path), rules, path_col, text_col)


def joined(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
