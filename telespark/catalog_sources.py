"""Registered source and scalar queries (O-02, O-03, O-24, O-75, O-76, O-79, O-83, O-84, O-86, O-87): documents and texts
are made from the given tables inside the query and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import register
from .functions import predicates as P
from .functions import scalars as SC
from .functions import time as TM
from .plans.oracle_views import with_views
from .sources import samples
from .sources import views as V
from .sources.traces_json import decode_traces, encode_traces

_HOUR = V.HOUR_US


def _documents(spark, sf_dir):
    """Every trace as a document; every fiftieth is cut short, as by a broken upload."""
    docs = encode_traces(V.spans_table(spark, sf_dir))
    cut = F.left("value", F.length("value") - 7)
    return docs.select("trace_id", F.when(F.col("trace_id") % 50 == 0, cut).otherwise(F.col("value")).alias("value"))


@register("decode_traces", with_views("spans") + """
SELECT trace_id, span_id, parent_span_id, service, service AS operation, start_us, duration_us, status
FROM spans WHERE trace_id % 50 <> 0""")
def q_decode_traces(spark, sf_dir):
    """Trace documents decoded against their schema; the broken ones are left to `rejected_documents`."""
    out = decode_traces(_documents(spark, sf_dir))["spans"]
    return out.select(F.col("trace_id").cast("bigint"), F.col("span_id").cast("bigint"),
                      F.col("parent_span_id").cast("bigint"), "service", "operation", "start_us", "duration_us", "status")


@register("rejected_documents", with_views("spans") + """
SELECT DISTINCT CAST(trace_id AS VARCHAR) AS trace_id, 'malformed' AS reason FROM spans WHERE trace_id % 50 = 0""")
def q_rejected_documents(spark, sf_dir):
    """The texts that do not decode, with the reason."""
    out = decode_traces(_documents(spark, sf_dir), spans=False)["rejected"]
    return out.select(F.regexp_extract("text", '"traceID":"([^"]*)"', 1).alias("trace_id"), "reason")


@register("matrix_samples", with_views("requests") + f"""
SELECT service AS series, ts_us // {_HOUR} * {_HOUR} AS ts_us, CAST(count(*) AS DOUBLE) AS value FROM requests GROUP BY 1, 2""")
def q_matrix_samples(spark, sf_dir):
    """Hourly counts per service as matrix documents, one per service and day, read back."""
    hour = (F.floor(F.col("ts_us") / _HOUR) * _HOUR).cast("bigint")
    per = V.requests(spark, sf_dir).groupBy("service", hour.alias("t")).agg(F.count(F.lit(1)).alias("n"))
    pair = F.array((F.col("t") / 1000000).cast("decimal(20,3)").cast("string"), F.col("n").cast("string"))
    day = per.groupBy("service", F.floor(F.col("t") / V.DAY_US)).agg(F.collect_list(pair).alias("values"))
    result = F.struct(F.create_map(F.lit("service_name"), "service").alias("metric"), F.col("values"))
    doc = F.struct(F.lit("success").alias("status"),
                   F.struct(F.lit("matrix").alias("resultType"), F.array(result).alias("result")).alias("data"))
    text = day.select(F.to_json(doc).alias("value"))
    docs = text.select(F.from_json("value", samples.MATRIX_SCHEMA).alias("d")).select("d.*")
    return samples.flatten_matrix(docs).select("series", "ts_us", "value")


@register("iso_instants", with_views("requests") + """,
t AS (SELECT request_id, ts_us // 1000 * 1000 AS ms_us, strftime(make_timestamp(ts_us // 1000 * 1000), '%Y-%m-%dT%H:%M:%S.%g') AS base FROM requests)
SELECT request_id, base || 'Z' AS text, ms_us AS back_us, ms_us - 7200000000 AS east_us, CAST(NULL AS BIGINT) AS naive_us FROM t""")
def q_iso_instants(spark, sf_dir):
    """Instants as text and back: UTC, an offset of two hours, and without a zone (refused)."""
    r = V.requests(spark, sf_dir).select("request_id", TM.iso_utc(F.col("ts_us"), millis=True).alias("text"))
    bare = F.regexp_replace("text", "Z$", "")
    return r.select("request_id", "text", TM.parse_iso_strict("text").alias("back_us"),
                    TM.parse_iso_strict(F.concat(bare, F.lit("+02:00"))).alias("east_us"),
                    TM.parse_iso_strict(bare).alias("naive_us"))


@register("scalar_functions", with_views("requests") + """
SELECT request_id, round_even(duration_ms, 1) AS rounded, regexp_full_match(lower(to_hex(request_id)) || route, '[0-9a-fA-F]+') AS hex_path,
  regexp_full_match(lower(to_hex(request_id)), '[0-9a-fA-F]+') AS hex_id,
  left(repeat(route || ' ', 40), 120) AS detail, CASE WHEN status = 500 THEN 'n/a' ELSE printf('%.3f', duration_ms) END AS shown
FROM requests""")
def q_scalar_functions(spark, sf_dir):
    """Half-even rounding, hex checks, texts cut to 120 characters, report values."""
    r = V.requests(spark, sf_dir)
    name = F.lower(F.hex("request_id"))
    return r.select("request_id", SC.round_half_even("duration_ms").alias("rounded"),
                    P.is_hex(F.concat(name, F.col("route"))).alias("hex_path"), P.is_hex(name).alias("hex_id"),
                    SC.truncate_text(F.repeat(F.concat("route", F.lit(" ")), 40)).alias("detail"),
                    SC.format_value(F.when(F.col("status") != 500, F.col("duration_ms"))).alias("shown"))
