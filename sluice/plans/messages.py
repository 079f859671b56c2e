"""Queries over events as topic messages: scans, routing, batches and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sluice import envelope
from sluice.functions import codec, dynamic as D, text as X
from sluice.operators import batching, routing, scripts, stats
from sluice.operators.ranking import newest
from sluice.plans.catalog import query
from sluice.plans.inputs import CONTENT_JSON, KEY_JSON, MESSAGES_SQL, envelopes, messages, table
from sluice.sources import documents, tables as sql_tables

ROUTES = routing.routes(("events-click", "click", 0), ("events-p*", "purchase-like", 1), ("events-*", "default", 2))
SOME_ROUTES = routing.routes(("events-click", "click", 0), ("events-p*", "purchase-like", 1), ('"events-*up"', "up", 2))

WITH = f"WITH {MESSAGES_SQL}"


@query("S-4", "X-1", "J-1", "P-1", "P-5", "A-1", "A-8", sql="""
SELECT 'events-' || event_type AS topic,
       CASE WHEN event_type = 'click' THEN 'click' WHEN event_type LIKE 'p%' THEN 'purchase-like' ELSE 'default' END AS handler,
       count(*) AS messages, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS total
FROM events GROUP BY ALL""")
def routed_topic_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    parsed = events.select(
        F.concat(F.lit("events-"), "event_type").alias("topic"),
        codec.text_to_json(F.col("props")).alias("props"),
    )
    read = parsed.select("topic", D.as_int(D.select(F.col("props"), "k")).alias("k"))
    # the handler depends on the topic alone, so it is looked up once per topic, after folding
    folded = read.groupBy("topic").agg(F.count(F.lit(1)).alias("messages"), F.sum("k").alias("total"))
    return folded.select("topic", routing.handler_for(F.col("topic"), ROUTES).alias("handler"), "messages", "total")


@query("S-4", sql=WITH + """
SELECT topic, partition_id AS "partition", msg_offset AS "offset", timestamp_ms AS "timestamp",
       '{"id":"u' || user_id || '"}' AS "key", content_json AS content, 'events' AS source, CAST(user_id AS VARCHAR) AS "user"
FROM messages""")
def envelope_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = envelopes(spark, sf_dir, offsets=True)
    return e.select(
        "topic", "partition", "offset", "timestamp",
        F.to_json("key").alias("key"), F.to_json("content").alias("content"),
        F.try_element_at("headers", F.lit("source")).alias("source"),
        F.try_element_at("headers", F.lit("user")).alias("user"),
    )


@query("S-2", sql="""
SELECT form, 'events-' || event_type AS topic, count(*) AS n
FROM events, (VALUES ('one', '^events-click$'), ('list', '^events-(click|error)$'), ('pattern', '^events-.*e.*$')) AS forms(form, re)
WHERE regexp_matches('events-' || event_type, re) GROUP BY ALL""")
def subscribed_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics = table(spark, sf_dir, "events").select(F.concat(F.lit("events-"), "event_type").alias("topic"))
    counted = topics.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    forms = {"one": "events-click", "list": "events-click,events-error", "pattern": "events-.*e.*"}
    # a message can match several subscriptions: one row per form that holds for its topic
    matched = F.array_compact(
        F.array(*[F.when(routing.subscribed(F.col("topic"), text), F.lit(form)) for form, text in forms.items()])
    )
    return counted.select(F.explode(matched).alias("form"), "topic", "n")


@query("J-1", sql=WITH + """
SELECT topic, handler, CASE WHEN handler IS NULL THEN 'No mapping found for ''' || topic || '''' END AS route_error, n FROM (
  SELECT topic, CASE WHEN topic = 'events-click' THEN 'click' WHEN topic LIKE 'events-p%' THEN 'purchase-like'
                     WHEN topic LIKE 'events-%up' THEN 'up' END AS handler, count(*) AS n
  FROM messages GROUP BY ALL)""")
def route_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = routing.route(messages(spark, sf_dir).select("topic"), SOME_ROUTES)
    return routed.groupBy("topic", "handler", "route_error").agg(F.count(F.lit(1)).alias("n"))


@query("J-1", sql=WITH + """
SELECT event_id, CASE WHEN topic = 'events-click' THEN 'click' WHEN topic LIKE 'events-p%' THEN 'purchase-like' ELSE 'default' END AS handler
FROM messages""")
def route_lookup_by_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = routing.route_by_topic(messages(spark, sf_dir).select("event_id", "topic"), ROUTES)
    return routed.select("event_id", "handler")


CHUNK = 1000

CHUNKS_SQL = MESSAGES_SQL + f""",
chunked AS (SELECT *, CAST((row_number() OVER (ORDER BY event_id) - 1) // {CHUNK} AS BIGINT) AS chunk FROM messages)"""


def _chunked(spark: SparkSession, sf_dir: str, offsets: bool = False) -> DataFrame:
    # chunk totals need the event ids only, not the offsets
    return batching.chunks(messages(spark, sf_dir, offsets), "event_id", CHUNK, totals_from=messages(spark, sf_dir))


@query("A-1", "X-13", "W-4", sql=f"""WITH {CHUNKS_SQL}
SELECT chunk, topic, count(*) AS n, 'Batch for ' || topic || ' of ' || count(*) || ' : [' ||
       string_agg(partition_id || ':' || msg_offset, ', ' ORDER BY partition_id, msg_offset) || ']' AS batch
FROM chunked GROUP BY chunk, topic""")
def topic_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.struct("event_id", F.col("partition_id").alias("partition"), F.col("msg_offset").alias("offset"))
    batches = batching.by_topic(_chunked(spark, sf_dir, offsets=True), message)
    return batches.select("chunk", "topic", "n", batching.batch_text(F.col("topic"), F.col("messages")).alias("batch"))


@query("A-2", "A-8", sql=WITH + "SELECT topic AS pipeline, count(*) AS total_records FROM messages GROUP BY topic")
def record_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.totals(messages(spark, sf_dir).select(F.col("topic").alias("pipeline")))


@query("A-2", "W-2", sql=WITH + """
SELECT pipeline, recency, event_id, content FROM (
  SELECT topic AS pipeline, row_number() OVER (PARTITION BY topic ORDER BY timestamp_ms DESC, event_id DESC) AS recency,
         event_id, content_json AS content FROM messages) WHERE recency <= 100""")
def recent_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir).select(F.col("topic").alias("pipeline"), "event_id", "timestamp_ms", F.col("content_json").alias("content"))
    kept = stats.recent(m, [F.desc("timestamp_ms"), F.desc("event_id")], "event_id")
    return kept.select("pipeline", F.col("recency").cast("bigint").alias("recency"), "event_id", "content")


# A batch fails when it holds a message worth 0 cents modulo 61.
FAILS = "value_cents % 61 = 0"


def _outcomes(spark: SparkSession, sf_dir: str, offsets: bool = False) -> DataFrame:
    """Messages with their chunk, and whether their batch failed, which takes one narrow row per batch."""
    chunked = _chunked(spark, sf_dir, offsets)
    cents = D.as_long_opt(D.select(codec.text_to_json(F.col("content_json")), "value_cents"))
    marked = chunked.withColumn("bad", F.coalesce(cents % 61 == 0, F.lit(False)))
    return marked.withColumn("pipeline", F.col("topic"))


OUTCOMES_SQL = CHUNKS_SQL + """,
outcomes AS (SELECT *, bool_or(CAST(content_json->>'$.value_cents' AS BIGINT) % 61 = 0) OVER (PARTITION BY chunk, topic) AS failed FROM chunked)"""


@query("A-3", sql=f"""WITH {OUTCOMES_SQL}
SELECT topic AS pipeline, count(*) AS total_records, count(DISTINCT chunk) AS total_batches,
       count(DISTINCT CASE WHEN failed THEN chunk END) AS failed_batches FROM outcomes GROUP BY topic""")
def batch_outcome_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.outcome_totals(_outcomes(spark, sf_dir).select("pipeline", "chunk", "topic", "bad"), "bad")


@query("A-3", "W-2", sql=f"""WITH {OUTCOMES_SQL}
SELECT topic AS pipeline, recency, topic || ' ' || partition_id || ':' || msg_offset AS message, content_json AS content FROM (
  SELECT *, row_number() OVER (PARTITION BY topic ORDER BY event_id DESC) AS recency FROM outcomes WHERE failed) WHERE recency <= 20""")
def batch_outcome_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = _outcomes(spark, sf_dir, offsets=True)
    failed = marked.groupBy("chunk", "topic").agg(F.bool_or("bad").alias("failed")).where("failed")
    errors = marked.join(failed, ["chunk", "topic"])
    kept = stats.recent_errors(errors, [F.desc("event_id")], "event_id")
    return kept.select(
        "pipeline", F.col("recency").cast("bigint").alias("recency"),
        stats.batch_message(F.col("topic"), F.col("partition_id"), F.col("msg_offset")).alias("message"),
        F.col("content_json").alias("content"),
    )


@query("A-3", "W-2", sql=WITH + """
SELECT topic AS pipeline, recency, topic || ' ' || partition_id || ':' || msg_offset AS message, '{"id":"u' || user_id || '"}' AS "key" FROM (
  SELECT *, row_number() OVER (PARTITION BY topic ORDER BY event_id DESC) AS recency FROM messages) WHERE recency <= 20""")
def batch_outcome_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = envelopes(spark, sf_dir, offsets=True).withColumn("pipeline", F.col("topic"))
    kept = stats.recent_outcomes(e, [F.desc("event_id")], "event_id")
    where = stats.coords(F.col("topic"), F.col("offset"), F.col("partition"), F.col("key"))
    return kept.select(
        "pipeline", F.col("recency").cast("bigint").alias("recency"),
        stats.batch_message(F.col("topic"), F.col("partition"), F.col("offset")).alias("message"),
        where["key"].alias("key"),
    )


@query("T-1", sql=WITH + """
SELECT topic, partition_id AS "partition", CAST(msg_offset // 50 AS BIGINT) AS batch, count(*) AS n,
       min(event_id) AS first_id, max(event_id) AS last_id FROM messages GROUP BY ALL""")
def count_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir).select("topic", F.col("partition_id").alias("partition"), "event_id")
    cut = batching.count_batches(m, ["topic", "partition"], "event_id", 50)
    return cut.groupBy("topic", "partition", "batch").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")
    )


# Events of a topic partition are some 25 minutes apart at the smallest scale.
WINDOW_MILLIS = 6 * 3600 * 1000
WINDOW_COUNT = 12


@query("T-1", sql=f"""WITH RECURSIVE {MESSAGES_SQL},
ends AS MATERIALIZED (
  SELECT m.topic, m.partition_id, m.msg_offset, least(m.msg_offset + {WINDOW_COUNT}, coalesce(n.msg_offset, 9223372036854775000)) AS next_start
  FROM messages m ASOF LEFT JOIN messages n
    ON m.topic = n.topic AND m.partition_id = n.partition_id AND m.timestamp_ms + {WINDOW_MILLIS} <= n.timestamp_ms),
starts AS (
  SELECT topic, partition_id, 0 AS msg_offset, 0 AS batch FROM (SELECT DISTINCT topic, partition_id FROM messages)
  UNION ALL
  SELECT s.topic, s.partition_id, e.next_start, s.batch + 1 FROM starts s
  JOIN ends e ON s.topic = e.topic AND s.partition_id = e.partition_id AND s.msg_offset = e.msg_offset),
numbered AS (
  SELECT m.topic, m.partition_id, m.event_id, s.batch FROM messages m ASOF JOIN starts s
    ON m.topic = s.topic AND m.partition_id = s.partition_id AND m.msg_offset >= s.msg_offset)
SELECT topic, partition_id AS "partition", CAST(batch AS BIGINT) AS batch, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id
FROM numbered GROUP BY ALL""")
def count_or_time_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir).select("topic", F.col("partition_id").alias("partition"), "event_id", "timestamp_ms")
    cut = batching.count_or_time_batches(m, ["topic", "partition"], "event_id", "timestamp_ms", WINDOW_COUNT, WINDOW_MILLIS)
    return cut.groupBy("topic", "partition", "batch").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")
    )


@query("X-13", sql=WITH + """
SELECT event_id, '{' || topic || ':' || partition_id || '/' || msg_offset || '@' || key_json || '}' AS coordinates,
       partition_id || ':' || msg_offset AS position FROM messages""")
def coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir, offsets=True)
    p, o = F.col("partition_id"), F.col("msg_offset")
    return m.select(
        "event_id", X.coordinates(F.col("topic"), p, o, F.col("key_json")).alias("coordinates"), X.position(p, o).alias("position")
    )


@query("X-16", "S-6", sql=f"""
SELECT event_id, event_id % 3 <> 0 AS complete, CASE WHEN event_id % 3 <> 0 THEN 'events-' || event_type END AS topic,
       CASE WHEN event_id % 3 <> 0 THEN {CONTENT_JSON} END AS content,
       CASE WHEN event_id % 3 <> 0 THEN '{{"content":' || {CONTENT_JSON} || ',"key":' || {KEY_JSON} || ',"timestamp":' || (epoch_us(ts) // 1000)
         || ',"headers":{{"source":"events","user":"' || user_id || '"}},"topic":"events-' || event_type || '","offset":' || event_id
         || ',"partition":' || (user_id % 4) || '}}' END AS json
FROM events""")
def envelope_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = envelopes(spark, sf_dir)
    text = envelope.to_json(e)
    # every third envelope loses a field and must not decode
    broken = F.regexp_replace(text, '"partition":\\d+', '"part":0')
    lines = e.select("event_id", F.when(F.col("event_id") % 3 == 0, broken).otherwise(text).alias("line"))
    read = envelope.read_json(lines, "line", "m")
    back = read.select("event_id", F.col("m.error").isNull().alias("complete"), "m.value.*")
    json = F.when(F.col("complete"), envelope.to_json(back)).alias("json")
    return back.select("event_id", "complete", "topic", F.to_json("content").alias("content"), json)


@query("S-8", sql="""
SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) AS "$row", row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS by_balance
FROM customer""")
def row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    upper = customers.toDF(*[c.upper() for c in customers.columns])
    numbered = sql_tables.with_row_numbers(upper, "C_CUSTKEY")
    ranked = sql_tables.with_sorted_row_numbers(customers, F.desc("c_acctbal"), "c_custkey")
    by_balance = ranked.select("c_custkey", F.col("`$row`").alias("by_balance"))
    return numbered.select("c_custkey", "c_name", "`$row`").join(by_balance, "c_custkey")


@query("P-14", sql=WITH + """
SELECT topic, partition_id AS "partition", event_id AS "offset", timestamp_ms AS "timestamp", CAST(user_id AS VARCHAR) AS "user",
       'u' || user_id AS "key", content_json->>'$.type' AS content FROM messages""")
def rekeyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = envelopes(spark, sf_dir)
    changed = envelope.rekey(e, D.field(F.col("key"), "id"), D.field(F.col("content"), "type"))
    return changed.select(
        "topic", "partition", "offset", "timestamp", F.try_element_at("headers", F.lit("user")).alias("user"),
        D.as_string(F.col("key")).alias("key"), D.as_string(F.col("content")).alias("content"),
    )


@query("F-1", "V-1", sql=WITH + """
SELECT event_id, (CAST(content_json->>'$.props.k' AS BIGINT) * 2) || '-' || (content_json->>'$.type') AS result
FROM messages WHERE CAST(content_json->>'$.event_id' AS BIGINT) = 12 OR CAST(content_json->>'$.value_cents' AS BIGINT) <= 1234""")
def rule_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    scripts.register_functions(spark)
    e = envelopes(spark, sf_dir)
    kept = scripts.filter_messages(e, "as_long(content:event_id, -1) = 12 or as_number(content:value_cents, 0) <= 1234")
    mapped = scripts.map_messages(kept, "(as_long(content:props.k, 0) * 2) || '-' || as_text(content:type)")
    return mapped.select("event_id", "result")


@query("W-4", "W-2", sql=WITH + """
SELECT partition_id AS "partition", event_id, place FROM (
  SELECT partition_id, event_id, row_number() OVER (PARTITION BY partition_id ORDER BY value DESC, event_id) AS place FROM messages) WHERE place <= 10""")
def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 4).cast("int").alias("partition"), "event_id", "value")
    kept = newest(e, ["partition"], [F.desc("value"), F.asc("event_id")], 10, "event_id", "place")
    return kept.select("partition", "event_id", F.col("place").cast("bigint").alias("place"))


@query("S-6", "A-1", sql=WITH + """
SELECT topic, count(*) AS n, CAST(sum(CAST(content_json->>'$.props.k' AS BIGINT)) AS BIGINT) AS total FROM messages GROUP BY topic""")
def json_message_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = envelopes(spark, sf_dir)
    read = documents.messages(e.select(envelope.to_json(e).alias("value")))
    k = D.as_int(D.select(F.col("content"), "props", "k"))
    return read.where(F.col("error").isNull()).groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"))
