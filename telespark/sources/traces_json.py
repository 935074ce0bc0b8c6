"""Nested trace documents -> flat spans (O-02, D3/D4).

Document: {data: [{traceID, processes: {id: {serviceName}}, spans: [{spanID,
operationName, processID, startTime, duration, references: [{refType, spanID}],
tags: [{key, value}]}]}]}. Parents are resolved with a join on the trace's own
span ids (first CHILD_OF reference that exists in the trace), never by collecting
a trace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import KEEP_TAGS
from ..session import stored, tasks_for

_REF = T.StructType([T.StructField("refType", T.StringType()), T.StructField("spanID", T.StringType())])
_TAG = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
_SPAN = T.StructType([
    T.StructField("spanID", T.StringType()), T.StructField("operationName", T.StringType()),
    T.StructField("processID", T.StringType()), T.StructField("startTime", T.LongType()),
    T.StructField("duration", T.LongType()), T.StructField("references", T.ArrayType(_REF)),
    T.StructField("tags", T.ArrayType(_TAG))])
TRACE_DOC_SCHEMA = T.StructType([T.StructField("data", T.ArrayType(T.StructType([
    T.StructField("traceID", T.StringType()),
    T.StructField("processes", T.MapType(T.StringType(), T.StructType([T.StructField("serviceName", T.StringType())]))),
    T.StructField("spans", T.ArrayType(_SPAN))])))])


def flatten_traces(docs: DataFrame) -> DataFrame:
    """Trace documents (TRACE_DOC_SCHEMA rows) -> one row per span (D3)."""
    t = docs.select(F.explode("data").alias("t")).select(
        F.col("t.traceID").alias("trace_id"), F.col("t.processes").alias("processes"),
        # tags become a map inside the generator, which runs once a span
        F.explode(F.transform("t.spans", lambda s: F.struct(
            *[s[c].alias(c) for c in _SPAN.names if c != "tags"], _last_wins_map(s["tags"]).alias("tags")))).alias("s"))
    spans = t.select(
        "trace_id",
        F.col("s.spanID").alias("span_id"),
        F.col("s.operationName").alias("operation"),
        F.coalesce(F.element_at("processes", F.col("s.processID"))["serviceName"], F.lit("?")).alias("service"),
        F.col("s.startTime").alias("start_us"), F.col("s.duration").alias("duration_us"),
        F.coalesce(F.col("s.references"), F.array().cast(T.ArrayType(_REF))).alias("_refs"),
        F.col("s.tags").alias("tags"))
    status = F.expr("try_cast(tags['http.response.status_code'] AS INT)")
    err = F.lower(F.coalesce(F.col("tags")["error"], F.lit("")))
    spans = (spans.withColumn("status", status)
             .withColumn("error", ~err.isin("", "false", "0", "null"))
             .withColumn("route", F.col("tags")["http.route"]))
    # the documents are parsed once; the joins below read columns of the stored spans
    spans = stored(spans)
    # parent: first CHILD_OF reference whose span exists in this trace (join on ids)
    refs = (spans.select(F.col("trace_id").alias("_t"), F.col("span_id").alias("_child"),
                         F.posexplode("_refs").alias("_pos", "_r"))
            .where(F.col("_r.refType") == "CHILD_OF")
            .select("_t", "_child", "_pos", F.col("_r.spanID").alias("_ref")))
    ids = spans.select(F.col("trace_id").alias("_t"), F.col("span_id").alias("_ref"))
    first = (refs.join(ids, ["_t", "_ref"])
             .groupBy("_t", "_child").agg(F.min_by("_ref", "_pos").alias("parent_span_id"))
             .withColumnRenamed("_t", "trace_id").withColumnRenamed("_child", "span_id"))
    with tasks_for(spans.sparkSession, spans.count()):
        first = stored(first)
    out = spans.join(first, ["trace_id", "span_id"], "left")
    return out.drop("_refs")


def _last_wins_map(tags):
    """Array of {key, value} -> map of the allowed keys; a repeated key keeps its last value."""
    arr = F.coalesce(tags, F.array().cast(T.ArrayType(_TAG)))
    allowed = F.reverse(F.filter(arr, lambda x: x["key"].isin(*KEEP_TAGS)))
    # the one-element array names the reversed list, so that it is made once: its first entry of a key stays
    return F.transform(F.array(allowed), lambda r: F.map_from_entries(F.reverse(F.filter(
        r, lambda x, i: F.array_position(r["key"], x["key"]) == i + 1))))[0]


def read_traces(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Read trace documents with an explicit schema and flatten them.

    multi_line=True reads whole-file documents (an exported evidence file; one task
    per file). At scale store one document per line (multi_line=False): JSON Lines
    files are split across tasks.
    """
    docs = spark.read.schema(TRACE_DOC_SCHEMA).option("multiLine", multi_line).json(path)
    return flatten_traces(docs)


_CORRUPT = "_corrupt_record"


def decode_traces(lines: DataFrame, text_col: str = "value", spans: bool = True) -> dict:
    """Trace documents as text, one per row, decoded against the schema.

    Returns `spans` (see `flatten_traces`) and `rejected` (text, reason): a text that is
    no JSON or does not fit the schema is 'malformed', one without a `data` array 'no data'.
    Nothing is lost: every row is in one of the two; null and blank texts are rejected.
    The spans are decoded and stored at once; `spans=False` leaves them out.
    """
    schema = T.StructType([*TRACE_DOC_SCHEMA.fields, T.StructField(_CORRUPT, T.StringType())])
    doc = F.from_json(F.col(text_col), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    # as a generated column a document is parsed once for all that is asked of it
    rows = lines.select(F.col(text_col).alias("text"), F.explode(F.array(doc)).alias("doc"))
    reason = (F.when(F.col("doc").isNull() | (F.trim("text") == "") | F.col(f"doc.{_CORRUPT}").isNotNull(), "malformed")
              .when(F.col("doc.data").isNull(), "no data"))
    rows = rows.withColumn("reason", reason)
    out = {"rejected": rows.where(F.col("reason").isNotNull()).select("text", "reason")}
    if spans:
        out["spans"] = flatten_traces(rows.where(F.col("reason").isNull()).select("doc.data"))
    return out


def encode_traces(spans: DataFrame) -> DataFrame:
    """trace_id, value: one document per trace, the form `decode_traces` reads (a trace's
    spans meet in one row, as they do in the document)."""
    name = F.coalesce("operation", "service") if "operation" in spans.columns else F.col("service")
    ref = F.struct(F.lit("CHILD_OF").alias("refType"), F.col("parent_span_id").cast("string").alias("spanID"))
    tag = F.struct(F.lit("http.response.status_code").alias("key"), F.col("status").cast("string").alias("value"))
    span = F.struct(F.col("span_id").cast("string").alias("spanID"), name.alias("operationName"),
                    F.col("service").alias("processID"), F.col("start_us").alias("startTime"),
                    F.col("duration_us").alias("duration"),
                    F.filter(F.array(ref), lambda r: r["spanID"].isNotNull()).alias("references"),
                    F.filter(F.array(tag), lambda t: t["value"].isNotNull()).alias("tags"))
    per = spans.groupBy("trace_id").agg(F.array_sort(F.collect_list(span)).alias("spans"),
                                        F.collect_set("service").alias("names"))
    processes = F.map_from_entries(F.transform("names", lambda n: F.struct(n, F.struct(n.alias("serviceName")))))
    doc = F.struct(F.array(F.struct(F.col("trace_id").cast("string").alias("traceID"), processes.alias("processes"),
                                    F.col("spans").alias("spans"))).alias("data"))
    return per.select("trace_id", F.to_json(doc).alias("value"))
