"""Views over the given tables that the registered queries share, each with its SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sluice.functions import codec
from sluice.operators.ranking import with_position
from sluice.session import shared_dir, spread
from sluice.sources import topics

PARTITIONS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Texts that mean the same in both engines.
KEY_JSON = """'{"id":"u' || user_id || '"}'"""
CONTENT_JSON = (
    """'{"event_id":' || event_id || ',"props":' || replace(props, ': ', ':') || ',"type":"' || event_type"""
    """ || '","value_cents":' || cast(round(value * 100) as bigint) || '}'"""
)


def as_messages(events: DataFrame) -> DataFrame:
    """Events, from a table or a stream, as topic messages with JSON texts."""
    return events.select(
        "event_id",
        F.concat(F.lit("events-"), "event_type").alias("topic"),
        F.expr(KEY_JSON).alias("key_json"),
        F.expr(CONTENT_JSON).alias("content_json"),
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) div 1000").alias("timestamp_ms"),
        (F.col("user_id") % PARTITIONS).cast("int").alias("partition_id"),
        F.create_map(F.lit("source"), F.lit("events"), F.lit("user"), F.col("user_id").cast("string")).alias("headers"),
    )


def messages(spark: SparkSession, sf_dir: str, offsets: bool = False, dealt: bool = False) -> DataFrame:
    """All events as topic messages. Offsets cost a shuffle, so they are optional, as is dealing the rows to all cores."""
    events = table(spark, sf_dir, "events")
    made = as_messages(spread(events) if dealt else events)
    return with_position(made, ["topic", "partition_id"], "event_id", "msg_offset") if offsets else made


MESSAGES_SQL = f"""messages AS (
  SELECT event_id, 'events-' || event_type AS topic, {KEY_JSON} AS key_json, {CONTENT_JSON} AS content_json,
         epoch_us(ts) // 1000 AS timestamp_ms, CAST(user_id % {PARTITIONS} AS INTEGER) AS partition_id,
         row_number() OVER (PARTITION BY event_type, user_id % {PARTITIONS} ORDER BY event_id) - 1 AS msg_offset,
         user_id, event_type, value, props
  FROM events)"""


def as_envelopes(m: DataFrame, offset: str = "event_id") -> DataFrame:
    """Messages as envelopes; ``event_id`` stays as the arrival order."""
    return m.select(
        "event_id",
        codec.text_to_json(F.col("content_json")).alias("content"),
        codec.text_to_json(F.col("key_json")).alias("key"),
        F.col("timestamp_ms").alias("timestamp"),
        "headers",
        "topic",
        F.col(offset).alias("offset"),
        F.col("partition_id").alias("partition"),
    )


def envelopes(spark: SparkSession, sf_dir: str, offsets: bool = False, dealt: bool = False) -> DataFrame:
    return as_envelopes(messages(spark, sf_dir, offsets, dealt), "msg_offset" if offsets else "event_id")


# A stream's micro-batches, each an equal range of event ids.
EPOCHS = 5
EPOCH = f"least({EPOCHS - 1}, (event_id - low) * {EPOCHS} {{div}} (high - low + 1))"
EPOCH_SQL = f"""epochs AS (
  SELECT event_id, {EPOCH.format(div='//')} AS epoch FROM events, (SELECT min(event_id) AS low, max(event_id) AS high FROM events))"""
# Files of a micro-batch: at least ``FILES``, and one for so many ids, or few tasks would do all of its work.
FILES, FILE_IDS = 2, 20_000


def event_stream(spark: SparkSession, sf_dir: str, file_ids: int = FILE_IDS) -> DataFrame:
    """The events as a stream in the order of their ids, in ``EPOCHS`` micro-batches of as many files each."""
    events, path = table(spark, sf_dir, "events"), shared_dir(spark, "events")
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    numbered = events.withColumn("low", F.lit(low)).withColumn("high", F.lit(high)).withColumn("epoch", F.expr(EPOCH.format(div="div")))
    # all micro-batches have as many files, and with so many ids for each no file is empty; rows of one id stay together
    counts = [r["n"] for r in numbered.groupBy("epoch").agg(F.count_distinct("event_id").alias("n")).collect()]
    files = max(FILES, min(counts) // file_ids) if len(counts) == EPOCHS else FILES
    for epoch in range(EPOCHS):
        part = numbered.where(F.col("epoch") == epoch).drop("low", "high", "epoch")
        part.repartition(files, "event_id").write.mode("append").parquet(path)
    return topics.file_stream(spark, path, files, schema=events.schema)


# Parts as documents: a scalar of changing type, an object, and arrays of numbers, texts and objects.
PART_DOC = """
  '{"brand":"' || p_brand || '","dims":[' || p_size || ',' || (p_size * 2) || ',' || (p_partkey % 5) || '],'
  || '"info":{"cents":' || cast(round(p_retailprice * 100) as bigint) || ',"type":"' || p_type || '"},'
  || CASE p_partkey % 10
       WHEN 0 THEN '"mix":7,' WHEN 1 THEN '"mix":1.5,' WHEN 2 THEN '"mix":"12",' WHEN 3 THEN '"mix":"true",'
       WHEN 4 THEN '"mix":true,' WHEN 5 THEN '"mix":null,' WHEN 6 THEN '"mix":2147483648,' WHEN 7 THEN '"mix":[1,2],'
       WHEN 8 THEN '"mix":{"a":1},' ELSE '' END
  || '"name":"' || p_name || '","parts":[' ||
  CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN '{"nested":[' || p_size || ',2],"no":1}'
       ELSE '{"nested":[1,2,3],"no":1},{"nested":[],"no":2},{"nested":[' || p_partkey || '],"no":3}' END
  || ']}'
"""


def part_documents(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """(p_partkey, doc: JSON text), with the parts dealt to all cores or as they are read."""
    parts = table(spark, sf_dir, "part")
    return (spread(parts) if dealt else parts).select("p_partkey", F.expr(PART_DOC).alias("doc"))


PART_DOCS_SQL = f"docs AS (SELECT p_partkey, CAST({PART_DOC} AS JSON) AS doc FROM part)"


# A schema registry with one subject per (brand, role): part sizes are its versions.
REGISTRY = [
    "lower(replace(p_brand, '#', '')) || CASE p_partkey % 3 WHEN 0 THEN '-key' WHEN 1 THEN '-value' ELSE '' END AS subject",
    "p_size AS version",
    "p_size * 1000 + cast(p_partkey % 1000 as int) AS id",
]
REGISTRY_SCHEMA = """
  CASE WHEN version % 7 = 0 THEN 'not a schema'
       ELSE '{"type":"record","name":"R' || version || '","fields":[{"name":"id","type":"long"},{"name":"n'
            || version || '","type":"int"}]}' END
"""


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, version, id, schema), one row per subject and version."""
    raw = table(spark, sf_dir, "part").selectExpr(*REGISTRY)
    once = raw.groupBy("subject", "version").agg(F.min("id").alias("id"))
    return once.withColumn("schema", F.expr(REGISTRY_SCHEMA))


REGISTRY_SQL = f"""registry AS (
  SELECT subject, version, id, {REGISTRY_SCHEMA} AS schema FROM (
    SELECT subject, version, min(id) AS id FROM (SELECT {', '.join(REGISTRY)} FROM part) GROUP BY subject, version))"""


# A change log over paths of documents: orders write, replace and delete their customer's entry.
CHANGES = [
    "o_orderkey AS seq",
    "'store/' || (o_custkey % 7) || '/' || CASE WHEN o_custkey % 5 = 0 THEN 'top' ELSE 'sub' || (o_custkey % 3) || '/doc' || (o_custkey % 40) END AS path",
    "CASE WHEN o_orderstatus = 'F' AND o_orderkey % 4 = 0 THEN 'delete' ELSE 'put' END AS op",
    "CASE WHEN o_orderstatus = 'F' AND o_orderkey % 4 = 0 THEN NULL ELSE '{\"status\":\"' || o_orderstatus || '\"}' END AS body",
]


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*CHANGES)


CHANGES_SQL = f"changes AS (SELECT {', '.join(CHANGES)} FROM orders)"
