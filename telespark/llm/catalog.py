"""Registered queries of the text operators, one per operator, and their DuckDB SQL.

Each reads its whole table with production parameters and derives the columns of its
contract from the operator's own output. Queries without SQL are checked against
brute-force versions in tests/llm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (codebooks, decontaminate, exact_dedup, factorisation, infill, jaccard_join, line_dedup,
               packing, personal, secrets, sharding, suffix_dedup, warc)
from .store import stash

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def _register(name: str, sql: str | None = None):
    def add(fn):
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLE[name] = sql
        return fn
    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_register("op1_sharding")
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shuffle_to_shards(_table(spark, sf_dir, "documents"), shards=8)
    text = F.col("record.text")
    return out.select(F.col("record.doc_id").alias("doc_id"), sharding.record_size(text).alias("size"),
                      F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
                      F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


@_register("op2_warc", """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY d)
SELECT p.page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND p.n >= 100""")
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(spark, _table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_register("op3_exact_dedup", r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = min(doc_id) OVER w AS kept, h AS text_sha256
FROM n WINDOW w AS (PARTITION BY h)""")
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


@_register("op4_quality")
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = factorisation.train_on(docs, _table(spark, sf_dir, "labels"))
    out = factorisation.score(docs, model, keep=[F.col("doc_id")])
    return out.select("row.doc_id", factorisation.held_out("row.doc_id").alias("held_out"), "score",
                      F.when(F.col("score") >= factorisation.THRESHOLD, 1).otherwise(0).alias("predicted"))


@_register("op5_suffix_dedup")
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removals(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@_register("op6_jaccard_join")
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_join.similar_components(_table(spark, sf_dir, "documents"), n=3, num=90, den=100)
    return jaccard_join.component_ids(out).select(
        F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), "component_id")


@_register("op7_secret_scan")
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(_table(spark, sf_dir, "documents"))
    spans = secrets.joined(F.col("findings"))

    def count(kind):
        return F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select(F.col("path").alias("doc_id"), count("assign"), count("access"), count("hex"),
                      F.sha2(spans.cast("binary"), 256).alias("base_sha256"), spans.alias("spans"))


@_register("op8_decontaminate")
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contaminations(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.groupBy(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).agg(
        F.max("best").alias("words_equal"))


@_register("op9_line_dedup", r"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines, row_number() OVER () AS page FROM documents),
pages AS (SELECT source, count(text) AS n FROM d GROUP BY source),
l AS (SELECT DISTINCT source, page, trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line
      FROM (SELECT source, page, unnest(lines) AS x FROM d)),
bad AS (SELECT l.source, line FROM l JOIN pages p ON l.source IS NOT DISTINCT FROM p.source
        WHERE line <> '' GROUP BY l.source, line, p.n HAVING count(*) >= 2 AND count(*) > p.n * 0.01),
drops AS (SELECT source, list(line) AS bad FROM bad GROUP BY source),
c AS (SELECT doc_id, lines, text, coalesce(drops.bad, []) AS bad FROM d LEFT JOIN drops ON d.source IS NOT DISTINCT FROM drops.source),
k AS (SELECT doc_id, text, lines,
      list_filter(lines, lambda x: NOT list_contains(bad, trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)))) AS kept FROM c)
SELECT doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(len(lines) - len(kept), 0) AS BIGINT) AS n_dropped,
  sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256 FROM k""")
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_lines(_table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "line_dedup.n_lines", "line_dedup.n_dropped",
                      F.sha2(F.coalesce("line_dedup.text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@_register("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@_register("op11_personal_data")
def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = personal.detect(_table(spark, sf_dir, "documents"), keep=[F.col("doc_id")])
    base = F.filter("findings", lambda x: x["base"])

    def count(kind):
        return F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("row.doc_id", *(count(kind) for kind in personal.BASE),
                      F.sha2(personal.joined(base).cast("binary"), 256).alias("base_sha256"),
                      personal.joined(F.col("findings")).alias("spans"))


@_register("op12_fill_in_middle", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l,
  sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
e AS (SELECT *, len(l) AS n,
  CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(l) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(l) + 1) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
       WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
f AS (SELECT doc_id, t, n, form, array_to_string(l[1:least(a, b)], '') AS p,
  array_to_string(l[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(l[greatest(a, b) + 1:], '') AS s FROM e)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
         ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM f""")
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.fill_in_middle(_table(spark, sf_dir, "documents"), keep=[F.col("doc_id")])
    digest = F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256")
    out = infill.restored(made, ["row.doc_id", "n", "form", "prefix_chars", "middle_chars", digest])
    return out.select("row.*", F.sha2(F.col("text").cast("binary"), 256).alias("restored_sha256"))


def _codebook_sql(rounds: int = codebooks.ROUNDS) -> str:
    """The rounds one after another, every part against every entry."""
    nearest = """a{k} AS MATERIALIZED (SELECT id, part, arg_min(entry, (dist, entry)) AS entry, min(dist) AS dist FROM (
  SELECT x.id, x.part, b.entry, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist
  FROM x JOIN b{k} b ON x.part = b.part) GROUP BY id, part)"""
    means = """b{next} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN (
  SELECT part, entry, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS v FROM (
    SELECT x.part, a.entry, i, CAST(sum(x.v[i]) AS DOUBLE) AS s, count(*) AS n
    FROM x JOIN a{k} a ON x.id = a.id AND x.part = a.part, unnest(range(1, len(x.v) + 1)) AS u(i) GROUP BY ALL)
  GROUP BY part, entry) m ON m.part = b.part AND m.entry = b.entry)"""
    steps = []
    for k in range(rounds):
        steps += [nearest.format(k=k), means.format(k=k, next=k + 1)]
    steps.append(nearest.format(k=rounds))
    return f"""
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS w,
  row_number() OVER (ORDER BY vec_id) - 1 AS id FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS MATERIALIZED (SELECT id, part, w[part * (len(w) // 4) + 1:(part + 1) * (len(w) // 4)] AS v
  FROM e, unnest(range(0, 4)) AS u(part)),
b0 AS MATERIALIZED (SELECT part, id AS entry, v FROM x WHERE id < 256),
{', '.join(steps)},
r AS (SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(dist) AS BIGINT) AS error
  FROM a{rounds} GROUP BY id),
s AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS print FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  print AS codebooks_sha256 FROM e JOIN r ON e.id = r.id, s"""


@_register("op13_vector_codes", _codebook_sql())
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = codebooks.prepared(_table(spark, sf_dir, "embeddings"), keep=[F.col("vec_id"), F.col("label")])
    books = codebooks.train(vectors)
    coded = stash(codebooks.compress(vectors, books).select("row.vec_id", "row.label", "codes", "error"), "codes")
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return codebooks.with_group_sum(coded, "label", "error", "label_error").select(
        "vec_id", code.alias("code"), "error", "label_error",
        F.lit(codebooks.fingerprint(books)).alias("codebooks_sha256"))
