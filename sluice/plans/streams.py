"""Queries that run a stream over the events and read back what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sluice.functions import dynamic as D, http as H
from sluice.operators import scripts
from sluice.operators.routing import routes
from sluice.operators.scripts import Context
from sluice.operators.stats import all_ok
from sluice.plans.catalog import ORACLES, query
from sluice.plans.inputs import EPOCH_SQL, MESSAGES_SQL, as_envelopes, as_messages, envelopes, event_stream
from sluice.plans.messages import WINDOW_COUNT, WINDOW_MILLIS
from sluice.session import shared_dir
from sluice.sinks import http as http_sink
from sluice.sinks.tables import read_epochs, write_epoch
from sluice.streaming import state
from sluice.streaming.pipeline import Pipeline, RestError, Tables, run_once

WITH = f"WITH {MESSAGES_SQL} "

ROUTES = routes(("events-click", "mapped"), ("events-view", "scripted"), ("events-p*", "posted"), ("events-e*", "broken"))
POINTS = "topic string, offset bigint, points bigint"


def _mapped(batch: DataFrame, context: Context) -> DataFrame:
    context.console.out("mapping clicks")
    points = D.as_int(D.select(F.col("content"), "props", "k")).cast("bigint")
    return batch.select("topic", "offset", points.alias("points"))


def _scripted(batch: DataFrame, context: Context) -> DataFrame:
    made = scripts.map_messages(batch, "as_long(content:props.k, 0) + as_long(content:value_cents, 0)", "points")
    return made.select("topic", "offset", "points")


def _always_refuses(method: str, url: str, headers: dict, body: bytes) -> tuple[int, str]:
    return 503, "busy"


def _posted(batch: DataFrame, context: Context) -> DataFrame:
    """Posts one request per message and fails unless all return 200."""
    requests = batch.withColumn("requests", F.array(H.with_body(H.post(F.lit("http://sink")), F.col("content"))))
    sent = context.kept(http_sink.post_all(requests.select("topic", "partition", "offset", "requests"), "requests", _always_refuses))
    bad = sent.where(~all_ok(F.col("results"))).count()
    if bad:
        raise RestError(f"{bad} messages were not accepted")
    return batch.select("topic", "offset", F.lit(0).cast("bigint").alias("points"))


def _broken(batch: DataFrame, context: Context) -> DataFrame:
    return scripts.map_messages(batch, "no_such_column + 1")


HANDLERS = {"mapped": _mapped, "scripted": _scripted, "posted": _posted, "broken": _broken}


def _run(spark: SparkSession, sf_dir: str) -> Pipeline:
    scripts.register_functions(spark)
    base = shared_dir(spark, "stream")
    pipeline = Pipeline("events", ROUTES, HANDLERS, Tables(base))
    run_once(as_envelopes(as_messages(event_stream(spark, sf_dir))).drop("event_id"), pipeline)
    return pipeline


@query("S-1", "T-2", "T-3", "V-2", sql=WITH + """
SELECT topic, event_id AS "offset", CAST(content_json->>'$.props.k' AS BIGINT)
       + CASE WHEN topic = 'events-view' THEN CAST(content_json->>'$.value_cents' AS BIGINT) ELSE 0 END AS points
FROM messages WHERE topic IN ('events-click', 'events-view')""")
def dispatched_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    pipeline = _run(spark, sf_dir)
    outputs = [pipeline.output(spark, name, POINTS).select("topic", "offset", "points") for name in ("mapped", "scripted")]
    return outputs[0].unionByName(outputs[1])


@query("T-4", "F-3", sql=WITH + """
SELECT topic, partition_id AS "partition", event_id AS "offset",
       CASE topic WHEN 'events-error' THEN 'broken' WHEN 'events-purchase' THEN 'posted' END AS handler,
       CASE topic WHEN 'events-error' THEN 'compile' WHEN 'events-purchase' THEN 'rest' ELSE 'compile' END AS error_kind,
       CASE topic WHEN 'events-error' THEN 'AnalysisException' WHEN 'events-purchase' THEN 'RestError' ELSE 'No mapping found for ''events-signup''' END AS error
FROM messages WHERE topic IN ('events-error', 'events-purchase', 'events-signup')""")
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = _run(spark, sf_dir).dead_letters(spark)
    # the part before the first colon names the error; the rest is Spark's own text
    return letters.select("topic", "partition", "offset", "handler", "error_kind", F.substring_index("error", ":", 1).alias("error"))


@query("A-2", "A-3", "T-2", "K-6", sql=WITH[:-1] + f", {EPOCH_SQL}" + """
SELECT topic, count(*) AS total_records, CAST(count(DISTINCT epoch) AS INTEGER) AS total_batches,
       CAST(CASE WHEN topic IN ('events-click', 'events-view') THEN 0 ELSE count(DISTINCT epoch) END AS INTEGER) AS failed_batches,
       CASE topic WHEN 'events-click' THEN 'mapping clicks' WHEN 'events-error' THEN 'broken: AnalysisException' WHEN 'events-purchase' THEN 'posted: RestError' END AS console
FROM messages JOIN epochs USING (event_id) GROUP BY topic""")
def stream_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    pipeline = _run(spark, sf_dir)
    line = F.col("line")
    about = F.when(line.startswith("mapping"), "events-click").when(line.startswith("broken"), "events-error").otherwise("events-purchase")
    console = pipeline.console(spark).select(about.alias("topic"), line.alias("console")).distinct()
    totals = pipeline.statistics(spark).join(console, "topic", "left")
    return totals.select("topic", "total_records", F.col("total_batches").cast("int").alias("total_batches"),
                         F.col("failed_batches").cast("int").alias("failed_batches"), "console")


@query("A-4", "K-4", "T-3", sql=WITH + """
SELECT topic, partition_id AS "partition", event_id AS "offset", 'posted' AS handler, 'http://sink yields 503' AS message, false AS ok,
       '{"request":{"body":' || content_json || ',"headers":{"Content-Type":"application/json"},"method":"POST","url":"http://sink"},"response":{"body":"busy","code":503}}' AS json
FROM messages WHERE topic = 'events-purchase'""")
def stream_http_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir).http_results(spark).drop("pipeline", "epoch")


def _read_back(spark: SparkSession, stream: DataFrame, label: str, schema: str, mode: str) -> DataFrame:
    """Run a stateful stream over all its input and read the rows it wrote, by epoch."""
    base = shared_dir(spark, label)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint")
    writer = writer.foreachBatch(lambda rows, epoch: write_epoch(rows, f"{base}/rows", label, epoch))
    writer.trigger(availableNow=True).start().awaitTermination()
    return read_epochs(spark, f"{base}/rows", schema)


@query("T-7", sql=WITH + """
SELECT topic || '/' || partition_id AS "key", count(*) AS n, arg_max(content_json->>'$.value_cents', event_id) AS latest FROM messages GROUP BY ALL""")
def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = as_envelopes(as_messages(event_stream(spark, sf_dir)))
    keyed = m.select(
        F.concat_ws("/", "topic", F.col("partition").cast("string")).alias("key"),
        D.as_string(D.field(F.col("content"), "value_cents")).alias("value"), F.col("event_id").alias("order"),
    )
    rows = _read_back(spark, state.cached(keyed), "cache", "key string, n bigint, latest string", "update")
    return rows.groupBy("key").agg(F.max("n").alias("n"), F.max_by("latest", "n").alias("latest"))


def _keyed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = as_messages(event_stream(spark, sf_dir))
    return m.select(
        F.concat_ws("/", "topic", F.col("partition_id").cast("string")).alias("key"),
        F.col("event_id").alias("order"), F.col("timestamp_ms").alias("time"), F.col("content_json").alias("value"),
    )


@query("T-1", sql=ORACLES["count_or_time_batches"])
def stream_count_or_time_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = shared_dir(spark, "numbered")
    numbered = state.NumberedBatches(base, ["key"], "order", "time", WINDOW_COUNT, WINDOW_MILLIS)
    keyed = _keyed_events(spark, sf_dir).drop("value")
    writer = keyed.writeStream.option("checkpointLocation", f"{base}/checkpoint").foreachBatch(numbered)
    writer.trigger(availableNow=True).start().awaitTermination()
    return numbered.rows(spark, "key string, order bigint, time bigint, batch bigint").groupBy("key", "batch").agg(
        F.count(F.lit(1)).alias("n"), F.min("order").alias("first_id"), F.max("order").alias("last_id")
    ).select(
        F.substring_index("key", "/", 1).alias("topic"), F.substring_index("key", "/", -1).cast("int").alias("partition"),
        "batch", "n", "first_id", "last_id",
    )


LIVE_COUNT = 30


@query("T-1", sql=WITH + f"""
SELECT topic || '/' || partition_id AS "key", count(*) // {LIVE_COUNT} AS closed_batches, count(*) // {LIVE_COUNT} * {LIVE_COUNT} AS records, 'count' AS closed
FROM messages GROUP BY ALL HAVING count(*) >= {LIVE_COUNT}""")
def stream_live_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full batches of each key; which records a batch has depends on their arrival, how many does not."""
    rows = _read_back(spark, state.live_batches(_keyed_events(spark, sf_dir), LIVE_COUNT, 0, live=False), "live", state.CLOSED, "append")
    batches = rows.groupBy("key", "batch", "closed").agg(F.count_distinct("order").alias("n"))
    return batches.groupBy("key", "closed").agg(F.count(F.lit(1)).alias("closed_batches"), F.sum("n").alias("records"))


def _seen(key, rows, cache):
    """A user's state: the least and greatest order and the sum of all orders so far, and the epochs that it was in."""
    low, high, total = int(cache.get("low", str(1 << 62))), int(cache.get("high", "-1")), int(cache.get("total", "0"))
    for row in rows:
        low, high, total = min(low, row["order"]), max(high, row["order"]), total + row["order"]
    turns = int(cache.get("turns", "0")) + 1
    cache.update(low=str(low), high=str(high), total=str(total), turns=str(turns))
    yield key, low, high, total, turns


@query("T-7", sql=WITH[:-1] + f", {EPOCH_SQL}" + """
SELECT topic || '/' || partition_id AS "key", min(event_id) AS low, max(event_id) AS high, CAST(sum(event_id) AS BIGINT) AS total,
       count(DISTINCT epoch) AS turns FROM messages JOIN epochs USING (event_id) GROUP BY ALL""")
def stream_user_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "key string, low bigint, high bigint, total bigint, turns bigint"
    rows = _read_back(spark, state.with_state(_keyed_events(spark, sf_dir), _seen, schema), "user", schema, "append")
    return rows.groupBy("key").agg(*[F.max_by(c, "turns").alias(c) for c in ("low", "high", "total")], F.max("turns").alias("turns"))


def _lines(batch: DataFrame, context: Context) -> DataFrame:
    return scripts.log_lines(batch, F.concat(F.lit("publishing "), F.to_json("content"), F.lit(" to "), "topic"))


@query("K-6", "V-2", sql=WITH + """
SELECT 'stdout' AS stream, topic, event_id AS "offset", partition_id AS "partition", 'publishing ' || content_json || ' to ' || topic AS line FROM messages""")
def handler_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(envelopes(spark, sf_dir), Context())


@query("A-2", "A-3", "W-2", sql=WITH + """
SELECT kind, topic, event_id AS "offset", topic || ' ' || partition_id || ':' || event_id AS message, key_json AS "key", content_json AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY kind ORDER BY timestamp_ms DESC, event_id DESC) AS r FROM (
    SELECT 'record' AS kind, * FROM messages UNION ALL SELECT 'error', * FROM messages WHERE topic NOT IN ('events-click', 'events-view')))
WHERE r <= CASE kind WHEN 'record' THEN 100 ELSE 20 END""")
def stream_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    pipeline = _run(spark, sf_dir)
    records = pipeline.recent_records(spark).withColumn("kind", F.lit("record"))
    errors = pipeline.recent_errors(spark).withColumn("kind", F.lit("error"))
    return records.unionByName(errors).select("kind", "topic", "offset", "message", "key", "value")
