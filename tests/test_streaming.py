import json
import time

import pytest
from pyspark.sql import functions as F

from sluice import envelope, session
from sluice.functions import dynamic as D
from sluice.operators.routing import routes
from sluice.sinks import http as http_sink, tables, topics as topic_sink
from sluice.sources import documents, topics
from sluice.streaming.pipeline import ConversionError, Manager, Pipeline, RestError, Tables, error_kind, run_once


@pytest.fixture(scope="module")
def record_dir(spark):
    """Three files of records in the Kafka layout, on topics good-a, good-b, bad and stray."""
    path = session.shared_dir(spark, "records")
    rows = spark.range(60).select(
        F.encode(F.concat(F.lit('{"id":'), F.col("id").cast("string"), F.lit("}")), "UTF-8").alias("key"),
        F.encode(F.concat(F.lit('{"n":'), F.col("id").cast("string"), F.lit("}")), "UTF-8").alias("value"),
        F.element_at(F.array(*map(F.lit, ("good-a", "good-b", "bad", "stray"))), (F.col("id") % 4 + 1).cast("int")).alias("topic"),
        (F.col("id") % 2).cast("int").alias("partition"), F.col("id").alias("offset"),
        F.timestamp_millis(F.col("id")).alias("timestamp"), F.lit(0).alias("timestampType"),
        F.array(F.struct(F.lit("h").alias("key"), F.lit(b"1").alias("value"))).alias("headers"),
    )
    rows.repartition(3, "offset").write.parquet(path)
    return path


CONFIG = topics.TopicConfig("good-a,good-b,bad,stray", key_type="json", value_type="json")
ROUTES = routes(("good*", "good"), ("bad", "bad"))
OUTPUT = "topic string, offset bigint, n int"


def good(batch, context):
    context.console.out("good")
    return batch.select("topic", "offset", D.as_int(D.select(F.col("content"), "n")).alias("n"))


def bad(batch, context):
    raise RestError("503")


def stream(spark, record_dir, max_files=1):
    return topics.envelopes(topics.file_stream(spark, record_dir, max_files), CONFIG)


def pipeline(spark):
    return Pipeline("p", ROUTES, {"good": good, "bad": bad}, Tables(session.shared_dir(spark, "pipeline")))


def test_stream_equals_table(spark, record_dir):
    p = pipeline(spark)
    run_once(stream(spark, record_dir), p)
    out = {tuple(r) for r in p.output(spark, "good", OUTPUT).select("topic", "offset", "n").collect()}
    table = topics.envelopes(spark.read.schema(envelope.RECORD).parquet(record_dir), CONFIG)
    expected = table.where(F.col("topic").startswith("good")).select("topic", "offset", D.as_int(D.select(F.col("content"), "n")).alias("n"))
    assert out == {tuple(r) for r in expected.collect()} and len(out) == 30
    letters = p.dead_letters(spark).groupBy("topic", "error_kind").count().collect()
    assert {tuple(r) for r in letters} == {("bad", "rest", 15), ("stray", "compile", 15)}
    totals = {r["topic"]: r for r in p.statistics(spark).collect()}
    assert {t: r["total_records"] for t, r in totals.items()} == dict.fromkeys(("good-a", "good-b", "bad", "stray"), 15)
    assert totals["bad"]["failed_batches"] == totals["bad"]["total_batches"] and totals["good-a"]["failed_batches"] == 0
    epochs = p.dead_letters(spark).select("epoch").distinct().count()
    assert epochs == 3
    newest = p.recent_records(spark).select("offset").collect()
    assert sorted(r["offset"] for r in newest) == list(range(60))
    errors = p.recent_errors(spark).select("offset", "message", "key", "value").collect()
    assert sorted(r["offset"] for r in errors) == [i for i in range(60) if i % 4 > 1][-20:]
    assert ("bad 0:58", '{"id":58}', '{"n":58}') in [(r["message"], r["key"], r["value"]) for r in errors]
    lines = p.console(spark).select("stream", "line").collect()
    assert lines.count(("stdout", "good")) == 3 and lines.count(("stderr", "bad: RestError")) == 3


def test_replayed_epoch_does_not_add(spark, record_dir):
    p = pipeline(spark)
    batch = topics.envelopes(spark.read.schema(envelope.RECORD).parquet(record_dir), CONFIG)
    assert p.dispatch(batch, 0) == 60 and p.dispatch(batch, 0) == 60
    assert p.output(spark, "good", OUTPUT).count() == 30 and p.dead_letters(spark).count() == 30
    assert p.statistics(spark).agg(F.sum("total_records")).first()[0] == 60


def test_empty_batch_is_a_no_op(spark, record_dir):
    p = pipeline(spark)
    batch = topics.envelopes(spark.read.schema(envelope.RECORD).parquet(record_dir), CONFIG)
    assert p.dispatch(batch.where("false"), 0) == 0
    assert p.dead_letters(spark).count() == 0 and p.statistics(spark).count() == 0


def test_restart_resumes_from_the_checkpoint(spark, record_dir):
    p = pipeline(spark)
    run_once(stream(spark, record_dir), p)
    run_once(stream(spark, record_dir), p)
    assert p.output(spark, "good", OUTPUT).count() == 30


def counted_answer(method, url, headers, body):
    with open(headers["log"], "a") as out:
        out.write("x")
    return (200 if body == b'{"n":0}' else 500), "b"


def test_http_results_are_kept_and_sent_once(spark, record_dir, tmp_path):
    from sluice.functions import http as H

    log = str(tmp_path / "sent")

    def posting(batch, context):
        requests = batch.withColumn("requests", F.array(H.with_body(H.post(F.lit("u"), F.create_map(F.lit("log"), F.lit(log))), F.col("content"))))
        sent = context.kept(http_sink.post_all(requests.drop("content", "key"), "requests", counted_answer))
        assert sent.count() == sent.where("results IS NOT NULL").count()
        raise RestError(str(sent.where(F.col("results")[0]["response"]["statusCode"] != 200).count()))

    p = Pipeline("p", routes(("good*", "post")), {"post": posting}, Tables(session.shared_dir(spark, "pipeline")))
    run_once(stream(spark, record_dir), p)
    rows = p.http_results(spark).collect()
    assert len(rows) == 30 == len(open(log).read()) and len({r["epoch"] for r in rows}) == 3
    assert [r["offset"] for r in rows if r["ok"]] == [0] and {r["message"] for r in rows if not r["ok"]} == {"u yields 500"}
    assert {r["handler"] for r in rows} == {"post"}


def test_missing_handler_goes_to_dead_letters(spark, record_dir):
    p = Pipeline("p", routes(("*", "nobody")), {}, Tables(session.shared_dir(spark, "pipeline")))
    p.dispatch(topics.envelopes(spark.read.schema(envelope.RECORD).parquet(record_dir), CONFIG), 0)
    assert {r["error_kind"] for r in p.dead_letters(spark).collect()} == {"convert"}


def test_dead_letters_hold_the_whole_message(spark, record_dir):
    p = pipeline(spark)
    p.dispatch(topics.envelopes(spark.read.schema(envelope.RECORD).parquet(record_dir), CONFIG), 0)
    letter = p.dead_letters(spark).where("offset = 58").first()
    assert (letter["topic"], letter["key"], letter["content"]) == ("bad", '{"id":58}', '{"n":58}')
    assert letter["timestamp"] is not None and "headers" in letter.asDict()


def test_handlers_named_like_paths(spark, record_dir):
    p = Pipeline("p", routes(("good*", "path/to/x.sc")), {"path/to/x.sc": good}, Tables(session.shared_dir(spark, "pipeline")))
    p.dispatch(topics.envelopes(spark.read.schema(envelope.RECORD).parquet(record_dir), CONFIG), 0)
    assert p.output(spark, "path/to/x.sc", OUTPUT).count() == 30


def test_pipelines_that_have_ended_do_not_run(spark, record_dir):
    manager = Manager(spark)
    ended = manager.start(stream(spark, record_dir), ROUTES, {"good": good, "bad": bad}, trigger={"availableNow": True})
    manager._running[ended].query.awaitTermination()
    assert manager.running() == [] and manager.input_rows(ended) == 60
    assert manager.stop(ended) is False


def test_append_of_a_replayed_micro_batch_does_not_add(spark):
    path = session.shared_dir(spark, "append")
    rows = spark.range(5).selectExpr("id AS n")
    assert [tables.append(rows, path, "p", epoch) for epoch in (3, 3, 4)] == [5, 5, 5]
    assert tables.read_epochs(spark, path, "n bigint").count() == 10


def test_error_kinds(spark):
    with pytest.raises(Exception) as caught:
        spark.range(1).select("nope")
    assert [error_kind(e) for e in (caught.value, RestError(), ConversionError(), KeyError())] == ["compile", "rest", "convert", "expression"]


def test_pipeline_lifecycle(spark, record_dir):
    manager = Manager(spark)
    handlers = {"good": good, "bad": bad}
    first = manager.start(stream(spark, record_dir), ROUTES, handlers, trigger={"processingTime": "100 milliseconds"}, config="one")
    second = manager.start(stream(spark, record_dir), ROUTES, handlers, trigger={"processingTime": "100 milliseconds"}, config="two")
    try:
        assert [r.config for r in manager.running()] == ["one", "two"]
        with pytest.raises(ValueError, match="already running"):
            manager.start(stream(spark, record_dir), ROUTES, handlers, name=first)
        manager.pipeline(first) and manager._running[first].query.processAllAvailable()
        deadline = time.time() + 30
        while manager.input_rows(first) < 60 and time.time() < deadline:
            time.sleep(0.2)
        assert manager.input_rows(first) >= 60
        assert manager.stats(first).agg(F.sum("total_records")).first()[0] == 60
        assert manager.stop(first) is True and manager.stop(first) is False
        assert [r.id for r in manager.running()] == [second]
    finally:
        manager.stop(first), manager.stop(second)
    assert manager.running() == [] and manager.stats(first) is not None and manager.stats("unknown") is None


@pytest.mark.parametrize("offset", ["earliest", "latest"])
def test_start_offsets(offset):
    config = topics.TopicConfig("a*", "host:9092", offset)
    assert config.kafka_options()["startingOffsets"] == offset
    assert config.kafka_options()["subscribePattern"] == "a*" and config.trigger() == {"processingTime": "0 milliseconds"}
    options = config.kafka_options()
    assert options["minOffsetsPerTrigger"] == "1000" and options["maxTriggerDelay"] == "10000ms" and "maxOffsetsPerTrigger" not in options


def test_bad_start_offset():
    with pytest.raises(ValueError, match="only earliest and latest"):
        topics.TopicConfig("a", offset="17")


def test_kafka_without_the_connector_says_so(spark):
    config = topics.TopicConfig("a", "host:9092")
    for build in (lambda: topics.kafka_stream(spark, config), lambda: topics.kafka_table(spark, config),
                  lambda: topic_sink.publish(spark.range(1).select(F.lit("k").alias("key"), F.lit("v").alias("value")), "host:9092")):
        with pytest.raises(topics.KafkaUnavailable):
            build()


def test_published_files_read_back_as_records(spark):
    path = session.shared_dir(spark, "published")
    frame = spark.range(4).select(F.col("id").cast("variant").alias("v"))
    made = topic_sink.record(frame, F.lit("out"), F.col("v"), F.when(F.expr("variant_get(v, '$', 'int')") > 0, F.col("v")), key_type="string", value_type="long", partition=F.lit(0))
    topic_sink.publish_files(made, path)
    back = spark.read.parquet(path)
    assert back.count() == 4 and back.where("value is null").count() == 1 and {r["partition"] for r in back.collect()} == {0}



@pytest.mark.parametrize(("ids", "files"), [("id", 20), ("CASE WHEN id < 999 THEN id ELSE 1000000 END", 2), ("id div 2", 10)])
def test_micro_batches_have_files_by_their_ids(spark, ids, files):
    from sluice.plans import inputs

    base = session.shared_dir(spark, "own-events")
    rows = spark.range(1000).selectExpr(f"{ids} AS event_id", "'x' AS event_type")
    rows.write.parquet(f"{base}/events.parquet")
    low, high = rows.selectExpr("min(event_id)", "max(event_id)").first()
    seen = {}

    def look(batch, epoch):
        found = batch.select("event_id", "file").collect()
        seen[epoch] = (sorted(r["event_id"] for r in found), len({r["file"] for r in found}))

    stream = inputs.event_stream(spark, base, file_ids=10).withColumn("file", F.input_file_name())
    stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").foreachBatch(look).trigger(availableNow=True).start().awaitTermination()
    if files > 2:
        assert {e: n for e, (_, n) in seen.items()} == dict.fromkeys(range(5), files)
        assert all(min(4, (i - low) * 5 // (high - low + 1)) == e for e, (found, _) in seen.items() for i in found)
    assert sorted(i for found, _ in seen.values() for i in found) == sorted(r["event_id"] for r in rows.collect())


def flaky(method, url, headers, body):
    if url.endswith("down"):
        raise ConnectionError("refused")
    return 200, f"{method} {json.loads(body)['a']} {headers['h']}"


def test_http_sink_reports_and_never_raises(spark):
    from sluice.functions import http as H

    def call(url):
        return H.with_body(H.post(F.lit(url), F.create_map(F.lit("h"), F.lit("1"))), F.parse_json(F.lit('{"a":7}')))

    frame = spark.range(1).select(F.array(call("up"), call("down")).alias("requests"), F.array().cast("array<int>").alias("none"))
    up, down = http_sink.post_all(frame, "requests", flaky, attempts=3, backoff=0.0).first()["results"]
    assert (up["response"]["statusCode"], up["response"]["body"], up["error"], up["attempts"]) == (200, "POST 7 1", None, 1)
    assert (down["response"], down["error"], down["attempts"]) == (None, "ConnectionError: refused", 3)


def test_materialised_rows(spark):
    path = session.shared_dir(spark, "materialised")
    rows = [(f"{i}", n, a) for i in (10, 100) for a in (2, 3) for n in ("foo", "bar", "BAR")]
    frame = spark.createDataFrame(rows, "id string, name string, amount int")
    shaped = tables.materialised(frame, F.col("name"), F.col("id"), F.col("amount"), F.to_json(F.struct("*")))
    assert tables.append(shaped, path) == 12 and tables.append(shaped, path) == 12
    assert spark.read.parquet(path).count() == 24
    assert tables.append(shaped, None) == -1 and tables.insert_jdbc(shaped, None, "t") == -1


def test_messages_from_json_lines(spark):
    lines = ['{"content":1,"key":"k","timestamp":0,"headers":{},"topic":"t","offset":0,"partition":0}', '{"content":1}', "junk"]
    read = documents.messages(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [r["error"] is None for r in read] == [True, False, False] and read[0]["topic"] == "t"


def test_shared_dir_uses_the_configured_folder(spark):
    assert session.shared_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
