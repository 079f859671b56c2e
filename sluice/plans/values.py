"""Queries over codecs, templates and text functions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sluice import envelope
from sluice.functions import codec, dynamic as D, records, text as X
from sluice.operators import scripts
from sluice.operators.schema import read_typed
from sluice.plans.catalog import query
from sluice.plans.inputs import MESSAGES_SQL, PART_DOCS_SQL, envelopes, messages, part_documents, table

# Payloads as they may arrive: JSON, other text, trailing content, numbers, nothing.
PAYLOAD = """
  CASE event_id % 8 WHEN 0 THEN replace(props, ': ', ':') WHEN 1 THEN event_type WHEN 2 THEN '' || user_id
       WHEN 3 THEN '"' || event_type || '"' WHEN 4 THEN user_id || ' ' || event_id WHEN 5 THEN '' WHEN 6 THEN '{"k":' ELSE NULL END
"""
PAYLOAD_JSON = """
  CASE event_id % 8 WHEN 0 THEN replace(props, ': ', ':') WHEN 1 THEN '"' || event_type || '"' WHEN 2 THEN '' || user_id
       WHEN 3 THEN '"' || event_type || '"' WHEN 4 THEN '"' || user_id || ' ' || event_id || '"' WHEN 5 THEN '""' WHEN 6 THEN '"{\\"k\\":"'
       ELSE 'null' END
"""


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("payload", F.expr(PAYLOAD))


@query("X-1", sql=f"""
SELECT event_id, {PAYLOAD_JSON} AS from_text, {PAYLOAD_JSON} AS from_bytes, CAST(user_id AS VARCHAR) AS from_long,
       CASE WHEN event_id % 8 = 1 THEN '"NaN"' ELSE event_id || '.5' END AS from_double,
       CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END AS from_bool,
       '{{"id":' || user_id || ',"kind":"' || event_type || '"}}' AS from_struct, '[' || user_id || ',7]' AS from_array,
       '{{"a":' || ({PAYLOAD_JSON}) || ',"b":1}}' AS from_map
FROM events""")
def any_to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.when(F.col("event_id") % 8 == 1, F.lit(float("nan"))).otherwise(F.col("event_id") + F.lit(0.5))
    typed = _payloads(spark, sf_dir).select(
        "event_id",
        F.col("payload").alias("from_text"),
        F.encode("payload", "UTF-8").alias("from_bytes"),
        F.col("user_id").alias("from_long"),
        half.alias("from_double"),
        (F.col("user_id") % 2 == 0).alias("from_bool"),
        F.struct(F.col("user_id").alias("id"), F.col("event_type").alias("kind")).alias("from_struct"),
        F.array("user_id", F.lit(7).cast("bigint")).alias("from_array"),
        F.create_map(F.lit("a"), F.col("payload"), F.lit("b"), F.lit("1")).alias("from_map"),
    )
    return typed.select(
        "event_id",
        *[F.to_json(codec.to_json_value(F.col(f.name), f.dataType)).alias(f.name) for f in typed.schema.fields[1:]],
    )


@query("X-2", sql="""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'NULL' ELSE event_type END AS from_text,
       to_base64(encode(event_type)) AS from_bytes, CAST(user_id AS VARCHAR) AS from_long,
       '{"id":' || user_id || '}' AS from_struct, event_type AS from_json_text, '{"k":' || CAST(props->>'$.k' AS BIGINT) || '}' AS from_json
FROM events""")
def any_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("from_text"),
        F.encode("event_type", "UTF-8").alias("from_bytes"),
        F.col("user_id").alias("from_long"),
        F.struct(F.col("user_id").alias("id")).alias("from_struct"),
        F.col("event_type").cast("variant").alias("from_json_text"),
        codec.text_to_json(F.col("props")).alias("from_json"),
    )
    return typed.select(
        "event_id", *[codec.to_text(F.col(f.name), f.dataType).alias(f.name) for f in typed.schema.fields[1:]]
    )


@query("S-5", sql="""
SELECT event_id, event_type AS as_string, user_id - 50 AS as_long, '{"k":' || CAST(props->>'$.k' AS BIGINT) || '}' AS as_json,
       CAST(user_id AS VARCHAR) AS as_bytes, true AS short_long_is_null
FROM events""")
def typed_deserialise(spark: SparkSession, sf_dir: str) -> DataFrame:
    wire = table(spark, sf_dir, "events").select(
        "event_id",
        F.encode("event_type", "UTF-8").alias("s"),
        codec.long_to_bytes(F.col("user_id") - 50).alias("l"),
        F.encode("props", "UTF-8").alias("j"),
        F.encode(F.col("user_id").cast("string"), "UTF-8").alias("b"),
    )
    return wire.select(
        "event_id",
        D.as_string(codec.deserialise(F.col("s"), "strings")).alias("as_string"),
        D.as_long_opt(codec.deserialise(F.col("l"), "longs")).alias("as_long"),
        F.to_json(codec.deserialise(F.col("j"), "json")).alias("as_json"),
        F.to_json(codec.deserialise(F.col("b"), "byte array")).alias("as_bytes"),
        codec.deserialise(F.col("b"), "long").isNull().alias("short_long_is_null"),
    )


@query("K-3", sql="""
SELECT event_id, '{"k":' || CAST(props->>'$.k' AS BIGINT) || '}' AS as_json, event_type AS as_string,
       '{"k":' || CAST(props->>'$.k' AS BIGINT) || '}' AS json_as_string, CAST(props->>'$.k' AS BIGINT) AS as_long,
       to_base64(encode(event_type)) AS as_bytes
FROM events""")
def typed_serialise(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        "event_id", codec.text_to_json(F.col("props")).alias("v"), F.col("event_type").cast("variant").alias("t")
    )
    return events.select(
        "event_id",
        codec.serialise(F.col("v"), "json").alias("as_json"),
        codec.serialise(F.col("t"), "string").alias("as_string"),
        codec.serialise(F.col("v"), "string").alias("json_as_string"),
        codec.serialise(D.field(F.col("v"), "k"), "long").alias("as_long"),
        F.base64(codec.serialise(F.col("t"), "bytes")).alias("as_bytes"),
    )


# A record's schema, and a newer one: another order, a wider number, a field more and one less.
OLDER = json.dumps({"type": "record", "name": "Event", "namespace": "own", "fields": [
    {"name": "user", "type": "int"}, {"name": "kind", "type": "string"}, {"name": "tags", "type": {"type": "array", "items": "string"}}]})
NEWER = json.dumps({"type": "record", "name": "Event", "namespace": "own", "fields": [
    {"name": "kind", "type": "string"}, {"name": "user", "type": "double"}, {"name": "note", "type": ["null", "string"], "default": None}]})


@query("S-5", "K-3", sql="""
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN upper(printf('000000000a%02x%02x', 2 * (user_id % 60), 2 * length(event_type)) || hex(event_type)
         || printf('02%02x', 2 * length(event_type)) || hex(event_type) || '00') END AS older_hex,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE '{"kind":"' || event_type || '","note":' || CASE WHEN event_id % 2 = 0 THEN 'null' ELSE '"n' || event_id || '"' END
         || ',"user":' || (user_id % 60) || '}' END AS read
FROM events""")
def schema_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of two schemas with their ids in front, all read as the newer; every fifth is cut short."""
    e = table(spark, sf_dir, "events").withColumn("user", F.col("user_id") % 60)
    older = F.to_json(F.struct("user", F.col("event_type").alias("kind"), F.array("event_type").alias("tags")))
    newer = F.to_json(F.struct(F.col("event_type").alias("kind"), "user", F.concat(F.lit("n"), F.col("event_id").cast("string")).alias("note")))
    even = F.col("event_id") % 2 == 0
    made = e.select("event_id", even.alias("even"), records.to_bytes(F.when(even, older), OLDER, 10).alias("o"), records.to_bytes(F.when(~even, newer), NEWER, 11).alias("n"))
    wire = F.coalesce("o", "n")
    cut = F.when(F.col("event_id") % 5 == 0, F.substring(wire, F.lit(1), F.octet_length(wire) - 1)).otherwise(wire)
    read = records.from_registry(F.col("wire"), {10: OLDER, 11: NEWER}, NEWER)
    staged = made.select("event_id", F.hex(F.when(F.col("even"), F.col("o"))).alias("older_hex"), cut.alias("wire"))
    return staged.select("event_id", "older_hex", F.to_json(F.parse_json(read)).alias("read"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages in the record layout, a third of them with a payload that is cut short."""
    m = messages(spark, sf_dir)
    text = F.when(F.col("event_id") % 3 == 0, F.substring("content_json", 1, 9)).otherwise(F.col("content_json"))

    def header(name: str, value) -> F.Column:
        return F.struct(F.lit(name).alias("key"), F.encode(value, "UTF-8").alias("value"))

    event = F.col("event_id").cast("string")
    return m.select(
        F.encode("key_json", "UTF-8").alias("key"), F.encode(text, "UTF-8").alias("value"), "topic",
        F.col("partition_id").alias("partition"), F.col("event_id").alias("offset"),
        F.timestamp_millis("timestamp_ms").alias("timestamp"), F.lit(0).alias("timestampType"),
        F.array(header("n", event), header("source", F.lit("events")), header("n", F.concat(event, F.lit("b")))).alias("headers"),
    )


@query("X-4", "S-4", sql=f"""WITH {MESSAGES_SQL}
SELECT topic, event_id AS "offset", partition_id AS "partition", timestamp_ms AS "timestamp", key_json AS "key",
       CASE WHEN event_id % 3 <> 0 THEN content_json END AS content,
       CASE WHEN event_id % 3 = 0 THEN 'Error transforming record' END AS error,
       CASE WHEN event_id % 3 = 0 THEN 'json' END AS supported_type,
       CASE WHEN event_id % 3 = 0 THEN '{{"event_i' END AS value_string
FROM messages""")
def error_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = envelope.from_records(_records(spark, sf_dir), "json", "json")
    content = F.col("content")
    failed = D.select(content, "error").isNotNull()
    return e.select(
        "topic", "offset", "partition", "timestamp", F.to_json("key").alias("key"),
        F.when(~failed, F.to_json(content)).alias("content"),
        *[
            F.when(failed, D.as_string(D.field(content, name))).alias(alias)
            for name, alias in (("error", "error"), ("supportedType", "supported_type"), ("valueString", "value_string"))
        ],
    )


@query("X-5", sql="SELECT event_id AS \"offset\", event_id || 'b' AS n, 'events' AS source, 2 AS size FROM events")
def header_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = _records(spark, sf_dir).select("offset", codec.header_map(F.col("headers")).alias("h"))
    return read.select(
        "offset", F.try_element_at("h", F.lit("n")).alias("n"), F.try_element_at("h", F.lit("source")).alias("source"),
        F.size("h").alias("size"),
    )


@query("X-20", sql=f"""WITH {PART_DOCS_SQL}
SELECT p_partkey, root, brand, cents, error FROM (
  SELECT p_partkey, 'doc' AS root, doc->>'$.brand' AS brand, CAST(doc->>'$.info.cents' AS BIGINT) AS cents, CAST(NULL AS VARCHAR) AS error FROM docs
  UNION ALL
  SELECT p_partkey, 'scalar', NULL, CASE WHEN p_partkey % 2 = 0 THEN p_partkey END,
         CASE WHEN p_partkey % 2 = 1 THEN 'cannot decode as struct<value:bigint>: {{"value":"' || p_partkey || '"}}' END FROM docs
  UNION ALL
  SELECT p_partkey, 'array', NULL, CAST(doc->>'$.dims[1]' AS BIGINT), NULL FROM docs)""")
def typed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = part_documents(spark, sf_dir)
    info = T.StructType([T.StructField("cents", T.LongType(), False)])
    doc = T.StructType([T.StructField("brand", T.StringType(), False), T.StructField("info", info, False)])
    scalar = T.StructType([T.StructField("value", T.LongType(), False)])
    array = T.StructType([T.StructField("array", T.ArrayType(T.LongType()), False)])
    key = F.col("p_partkey").cast("string")
    number = F.when(F.col("p_partkey") % 2 == 0, key).otherwise(F.concat(F.lit('"'), key, F.lit('"')))
    dims = F.get_json_object("doc", "$.dims")

    def rows(df: DataFrame, root: str, brand, cents) -> DataFrame:
        return df.select(
            "p_partkey", F.lit(root).alias("root"), brand.cast("string").alias("brand"), cents.alias("cents"),
            F.col("record.error").alias("error"),
        )

    none = F.lit(None)
    return (
        rows(read_typed(docs, "doc", doc), "doc", F.col("record.value.brand"), F.col("record.value.info.cents"))
        .unionByName(rows(read_typed(docs.withColumn("t", number), "t", scalar), "scalar", none, F.col("record.value.value")))
        .unionByName(rows(read_typed(docs.withColumn("t", dims), "t", array), "array", none, F.col("record.value.array")[1]))
    )


@query("X-8", "X-9", "X-18", sql=f"""WITH {MESSAGES_SQL}
SELECT event_id, 'key:u' || user_id || ' value: ' || (CAST(content_json->>'$.props.k' AS BIGINT) * 3) AS text,
       (content_json->>'$.type') || '-u' || user_id || '-ronment-' AS arr, 'some content' AS const, '' AS empty, 'hi "' || topic || E'"\\n!' AS lines
FROM messages""")
def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    scripts.register_functions(spark)
    e = envelopes(spark, sf_dir).withColumn("env", X.environment({"envi": "?", "host": "h"}, {"envi": "ronment"}))
    record = e.select("event_id", F.struct("content", "key", "topic").alias("record"), "env")
    config = X.render_config(
        {
            "test.arr": "{{ as_text(record.content:type) }}-{{ as_text(record.key:id) }}-{{ env.envi }}-{{ coalesce(env.nope, '') }}",
            "test.const": "some content",
            "lines": 'hi "{{ record.topic }}"\n!',
        }
    )
    text = X.render("key:{{ as_text(record.key:id) }} value: {{ as_long(record.content:props.k, 0) * 3 }}")
    rendered = record.select("event_id", text.alias("text"), X.render("").alias("empty"), config.alias("config"),
                             X.env(F.col("env"), "nope").alias("missing"))
    at = {"arr": "test.arr", "const": "test.const", "lines": "lines"}
    return rendered.select(
        "event_id", "text", F.concat("empty", "missing").alias("empty"),
        *[F.element_at("config", key).alias(name) for name, key in at.items()],
    )


@query("X-10", sql="""
SELECT event_id, event_type AS plain, event_type AS escaped, '"' || event_type || '"' AS one_layer, event_type AS all_layers,
       CASE WHEN event_id % 2 = 0 THEN '"' || event_type ELSE event_type END AS open_quote
FROM events""")
def unquoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    def around(left: str, right: str):
        return F.concat(F.lit(left), F.col("event_type"), F.lit(right))

    layered = around(' "" "', '" "" ')
    half_open = F.when(F.col("event_id") % 2 == 0, around('"', "")).otherwise(around("", ""))
    return table(spark, sf_dir, "events").select(
        "event_id",
        X.unquote(around(' "', '" ')).alias("plain"),
        X.unquote(around('\\"', '\\"')).alias("escaped"),
        X.unquote(around('""', '""')).alias("one_layer"),
        X.unquote_all(layered).alias("all_layers"),
        X.unquote_all(half_open).alias("open_quote"),
    )


@query("X-11", sql=r"""
SELECT page_id, regexp_replace(url, '[^\p{L}\p{Nd}]', '_', 'g') AS name FROM pages""")
def field_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.field_name(F.col("url")).alias("name"))


@query("X-6", sql="""
SELECT conv_id, turn, replace(role, 'a', '<A>') AS role, replace(text, 'a', '<A>') AS text, '<A>n' AS first_key, turn AS number FROM conversations""")
def replaced_in_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.to_json(F.struct(F.col("turn").alias("an"), "role", "text")).alias("doc")
    )
    v = codec.text_to_json(X.replace_in_json(F.col("doc"), "a", "<A>"))
    read = docs.select("conv_id", "turn", v.alias("v"))
    return read.select(
        "conv_id", "turn", D.as_string(D.field(F.col("v"), "role")).alias("role"), D.as_string(D.field(F.col("v"), "text")).alias("text"),
        F.element_at(F.array_sort(F.map_keys(D.as_map(F.col("v")))), 1).alias("first_key"),
        D.as_long_opt(D.select(F.col("v"), "<A>n")).alias("number"),
    )


@query("F-2", sql="""
SELECT event_id, event_id % 8 IN (5, 7) AS tombstone FROM events""")
def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = _payloads(spark, sf_dir).select("event_id", codec.text_to_json(F.col("payload")).alias("v"))
    return read.select("event_id", envelope.tombstone(F.col("v")).alias("tombstone"))


@query("V-1", "P-11", sql=f"""WITH {PART_DOCS_SQL}
SELECT p_partkey, CAST(unnest(json_extract(doc, '$.dims[*]')) AS BIGINT) AS result FROM docs""")
def scripted_flat_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    scripts.register_functions(spark)
    docs = part_documents(spark, sf_dir).select("p_partkey", codec.text_to_json(F.col("doc")).alias("content"))
    items = scripts.flat_map_messages(docs, "each(content:dims)", "item")
    return scripts.map_messages(items, "as_long(item, 0)").select("p_partkey", "result")
