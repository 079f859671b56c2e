import json
import random
import re
import threading
import time
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F, types as T

from sluice.functions import codec, dynamic as D, seeds as S
from sluice.operators import datagen, keyed, publish, registry as R, routing, schema, scripts, stats
from sluice.plans.generation import EVERY_TYPE, EXAMPLE
from sluice.sinks import http as http_sink
from sluice.sources import tables as sql_tables
from sluice.sources.topics import TopicConfig

# --- routing


@pytest.mark.parametrize(
    "topic, handler",
    [("foo", "file.sc"), ("bar", "path/to/file.sc"), ("bazz", "ba-default.sc"), ("buzz", None), ('"foo"', "file.sc"), ("ba", "ba-default.sc"), ("abar", None)],
)
def test_route_lookup(spark, topic, handler):
    table = routing.routes(("foo", "file.sc"), ("bar", "path/to/file.sc"), ("ba*", "ba-default.sc"))
    frame = spark.createDataFrame([(topic,)], "topic string")
    row = routing.route(frame, table).first()
    assert row["handler"] == handler
    assert (row["route_error"] is None) == (handler is not None)
    assert routing.route_by_topic(frame, table).first()["handler"] == handler


def test_wildcards_follow_priority_and_keep_regex_characters(spark):
    table = routing.routes(("a*", "late", 5), ("a.c*", "early", 1))
    frame = spark.createDataFrame([("abcd",), ("ax",)], "topic string")
    assert [r["handler"] for r in routing.route(frame, table).collect()] == ["early", "late"]


def test_a_topic_has_one_exact_route():
    with pytest.raises(ValueError, match="more than one"):
        routing.handler_for(F.lit("t"), routing.routes(("a", "x"), ("a", "y")))


def test_many_routes_agree_with_a_plain_search_and_cost_little_more(spark):
    entries = [(f"exact-{i}", f"e{i}") for i in range(1000)] + [(f"pre{i}.*x*", f"w{i}") for i in range(500)]
    entries += [(f"pre{i}*", f"v{i}") for i in range(499)] + [("*-end", "suffix"), ("a?b*", "optional"), ("x|exact-2*", "either")]
    table = routing.routes(*entries)
    names = [f"exact-{i}" for i in range(0, 1100, 7)] + [f"pre{i}{t}" for i in range(0, 600, 11) for t in ("", "-x-", "q", "-end")] + [
        "b", "abc", "x", "exact-2000", "none", "", "exact-", "pre", "pre7\nx"]
    wild = [(re.compile(r.regex.replace(r"\z", r"\Z")), r.handler) for r in sorted(table, key=lambda r: r.priority) if r.is_wildcard]
    exact = {r.pattern: r.handler for r in table if not r.is_wildcard}
    frame = spark.createDataFrame([(n,) for n in names], "topic string")
    got = {r["topic"]: r["h"] for r in frame.select("topic", routing.handler_for(F.col("topic"), table).alias("h")).collect()}
    assert got == {n: exact.get(n) or next((h for p, h in wild if p.match(n)), None) for n in names}

    def seconds(some):
        rows = spark.range(0, 400_000, 1, 4).select(F.concat(F.lit("pre"), (F.col("id") % 700).cast("string"), F.lit("-x")).alias("topic"))
        best = 1e9
        for _ in range(3):
            started = time.perf_counter()
            rows.select(routing.handler_for(F.col("topic"), some).alias("h")).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - started)
        return best

    wildcards = [(f"pre{i}-*", "h") for i in range(1000)]
    assert seconds(routing.routes(*entries[:1000], *wildcards)) < 3 * seconds(routing.routes(*entries[:2], *wildcards[:3])) + 0.5


def test_no_routes(spark):
    assert routing.route(spark.createDataFrame([("t",)], "topic string"), []).first()["handler"] is None


def test_subscriptions():
    assert routing.subscription("a") == ("subscribe", "a")
    assert routing.subscription("a,b") == ("subscribe", "a,b")
    assert routing.subscription("a.*") == ("subscribePattern", "a.*")


# --- seeds and samples


def wrap(x):
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


EDGES = [0, 1, -1, 123, 456, 2**31, -(2**31), 2**32, 2**63 - 1, -(2**63), -7046029254386353131]


def test_generator_matches_big_integers(spark):
    frame = spark.createDataFrame([(s,) for s in EDGES], "s bigint")
    for row in frame.select("s", S.next_seed(F.col("s")).alias("n"), S.advance(F.col("s"), 12).alias("m")).collect():
        seed = row["s"]
        assert row["n"] == wrap(seed * S.MULTIPLIER + S.INCREMENT)
        for _ in range(12):
            seed = wrap(seed * S.MULTIPLIER + S.INCREMENT)
        assert row["m"] == seed


@pytest.mark.parametrize("maximum", [0, 1, 6, -6, 2**31 - 1])
def test_bounded_ints(spark, maximum):
    frame = spark.createDataFrame([(s,) for s in EDGES], "s bigint")
    for row in frame.select("s", S.bounded_int(F.col("s"), maximum).alias("b")).collect():
        assert row["b"] == abs(row["s"]) % (abs(maximum) + 1)


def test_unit_doubles_and_shares(spark):
    frame = spark.createDataFrame([(s,) for s in EDGES], "s bigint")
    rows = frame.select(S.unit_double(F.col("s")), S.weighted_boolean(F.col("s"), 0.0), S.weighted_boolean(F.col("s"), 1.0)).collect()
    assert all(0 <= r[0] <= 1 and r[1] is False for r in rows)
    with pytest.raises(ValueError):
        S.weighted_boolean(F.lit(1), 1.5)


@pytest.mark.parametrize("seed, day", [(123, "MONDAY"), (456, "SATURDAY")])
def test_known_sample_days(spark, seed, day):
    row = spark.range(1).select(datagen.sample(EXAMPLE, F.lit(seed).cast("bigint")).alias("r")).first()["r"]
    assert row["day"] == day and row["addresses"][0]["name"] and len(row["addresses"]) == 2
    assert json.loads(datagen.sample_text(EXAMPLE, seed))["day"] == day


@pytest.mark.parametrize("text", [EXAMPLE, EVERY_TYPE])
def test_column_and_row_samples_agree(spark, text):
    frame = spark.createDataFrame([(s,) for s in EDGES], "s bigint")
    made = frame.select("s", F.to_json(datagen.sample(text, F.col("s")), {"ignoreNullFields": "false"}).alias("a"), datagen.sample_json(F.lit(text), F.col("s")).alias("b"))
    for row in made.collect():
        a, b = json.loads(row["a"]), json.loads(row["b"])
        if "someFloat" in a:
            assert np.float32(a.pop("someFloat")) == np.float32(b["someFloat"])
            assert float(np.float32(b["someFloat"])) == b.pop("someFloat")
        if "someDouble" in a:
            assert float(a.pop("someDouble")) == float(b.pop("someDouble"))
        assert a == b


def test_deep_schemas_have_samples(spark):
    text = '"int"'
    for level in range(400):
        text = f'{{"type":"record","name":"R{level}","fields":[{{"name":"f","type":{text}}}]}}'
    registry = spark.createDataFrame([("s", 1, text)], "subject string, version int, schema string")
    made = datagen.registry_samples(registry, F.lit(7).cast("bigint")).first()["sample"]
    assert made == '{"f":' * 400 + "7" + "}" * 400


RECURSIVE = '{"type":"record","name":"Node","fields":[{"name":"next","type":"Node"}]}'


@pytest.mark.parametrize("text", [RECURSIVE, "nope", '{"a":1}', '"unknown"', "[]", '{"type":"record","name":"R"}'])
def test_unusable_schemas(spark, text):
    with pytest.raises(datagen.BadSchema):
        datagen.sample(text, F.lit(1))
    assert spark.range(1).select(datagen.sample_json(F.lit(text), F.lit(1))).first()[0] is None


def test_recursion_behind_null_is_finite():
    text = '{"type":"record","name":"N","fields":[{"name":"next","type":["null","int","N"]}]}'
    assert set(json.loads(datagen.sample_text(text, 5))) == {"next"}


def test_parsed_documents(spark):
    texts = [EXAMPLE, '{ "jay" : "son" }', "not json", '{"type":"car"}', "[1,2]", '"string"', "7"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = datagen.parse_documents(frame, "t", F.lit(456).cast("bigint")).collect()
    assert [r["format"] for r in rows] == ["avro", "json", None, "json", "json", "avro", "json"]
    assert json.loads(rows[0]["document"])["day"] == "SATURDAY" and json.loads(rows[1]["document"]) == {"jay": "son"}
    assert ">not json<" in rows[2]["parse_error"] and rows[1]["parse_error"] is None


# --- schema inference

TYPES = {"root": {"nested": {"text": "hello", "nil": None, "int": 2147483647, "long": 9223372036854775807, "dec": 1.23, "truthy": False}}}


def texts(spark, *values):
    return spark.createDataFrame([(json.dumps(v),) for v in values], "t string")


def types_of(spark, *values):
    found = schema.path_types(texts(spark, *values), "t")
    return {(r["p"], r["type"]): r["n"] for r in found.select(schema.path_text(F.col("path")).alias("p"), "type", "n").collect()}


def test_json_types(spark):
    found = types_of(spark, TYPES)
    leaf = {p.rsplit(".", 1)[1]: t for p, t in found if p.count(".") == 3}
    assert leaf == {"text": "STRING", "nil": "NULL", "int": "INT", "long": "LONG", "dec": "DOUBLE", "truthy": "BOOLEAN"}


def test_avro_schema_of_records(spark):
    avro = schema.avro_schema(schema.infer(texts(spark, TYPES), "t"))
    nested = avro["fields"][0]["type"]["fields"][0]["type"]
    assert (avro["name"], avro["fields"][0]["type"]["name"], nested["name"]) == ("object", "rootType", "nestedType")
    assert {f["name"]: f["type"] for f in nested["fields"]} == {
        "text": "string", "nil": "null", "int": "int", "long": "long", "dec": "double", "truthy": "boolean"
    }


def test_mixed_records_merge(spark):
    avro = schema.avro_schema(schema.infer(texts(spark, {"mix-array": [{"foo": 2}, {"fizz": 3}, {"foo": "x"}]}), "t"))
    field = avro["fields"][0]
    assert field["name"] == "mix_array"
    assert {f["name"]: f["type"] for f in field["type"]["items"]["fields"]} == {"foo": ["null", "int", "string"], "fizz": ["null", "int"]}


def test_nested_fields_of_both_records_are_kept(spark):
    avro = schema.avro_schema(schema.infer(texts(spark, {"a": {"x": 1}}, {"a": {"y": True}}), "t"))
    assert {f["name"] for f in avro["fields"][0]["type"]["fields"]} == {"x", "y"}


@pytest.mark.parametrize("value, kind", [(123, "int"), (True, "boolean"), ("text", "string")])
def test_scalar_roots_are_wrapped(spark, value, kind):
    avro = schema.avro_schema(schema.infer(texts(spark, value), "t"))
    assert avro["fields"] == [{"name": "value", "type": kind}]


def test_array_roots_and_odd_keys(spark):
    assert types_of(spark, [[], [1, "x"]], {"[]": 1, "a.b": {}}) == {
        ("$", "ARRAY"): 1, ("$", "RECORD"): 1, ("$[]", "ARRAY"): 2, ("$[][]", "INT"): 1, ("$[][]", "STRING"): 1,
        ("$.[]", "INT"): 1, ("$.a.b", "RECORD"): 1,
    }


def test_generated_avro_schemas_parse_and_sample(spark):
    text = schema.avro_json(schema.infer(texts(spark, TYPES, {"root": {"list": [1], "empty": []}}), "t"))
    assert set(json.loads(datagen.sample_text(text, 1))["root"]) == {"nested", "list", "empty"}


def test_read_with_the_inferred_schema(spark):
    values = [{"root": {"numbers": [1, 2, 3], "bools": [True], "strings": ["a", "b"], "mixed": i if i else "x"}} for i in range(2)]
    frame = texts(spark, *values)
    merged = schema.spark_schema(schema.infer(frame, "t"))
    assert isinstance(merged["root"].dataType["mixed"].dataType, T.VariantType)
    read = schema.read_typed(frame, "t", merged)
    assert sorted((json.loads(r[0]) for r in read.select(F.to_json("record.value")).collect()), key=str) == sorted(values, key=str)


def test_union_of_frames(spark):
    left = spark.createDataFrame([(1, "x", [1])], "a int, b string, c array<int>")
    right = spark.createDataFrame([("y", True, [2])], "a string, d boolean, c array<int>")
    both = schema.union_all(left, right)
    assert dict(both.dtypes) == {"a": "variant", "b": "string", "c": "array<int>", "d": "boolean"}
    assert both.select(F.to_json("a")).collect() == [("1",), ('"y"',)]


def test_union_merges_records(spark):
    left = spark.sql("SELECT struct(1 AS x, struct('p' AS q) AS r, array(struct(1 AS i)) AS l) AS s, map('k', struct(1 AS m)) AS t")
    right = spark.sql("SELECT struct(2 AS y, struct(3 AS q, 4 AS z) AS r, array(struct('j' AS j)) AS l) AS s, map('k', struct(2 AS n)) AS t")
    both = schema.union_all(left, right)
    assert dict(both.dtypes) == {
        "s": "struct<x:int,r:struct<q:variant,z:int>,l:array<struct<i:int,j:string>>,y:int>", "t": "map<string,struct<m:int,n:int>>"}
    assert [json.loads(r[0]) for r in both.select(F.to_json("s")).collect()] == [
        {"x": 1, "r": {"q": "p"}, "l": [{"i": 1}]}, {"r": {"q": 3, "z": 4}, "l": [{"j": "j"}], "y": 2}]
    nothing = spark.sql("SELECT CAST(NULL AS struct<w: int>) AS s")
    assert schema.union_all(left, nothing).where("s IS NULL").count() == 1


# --- registry


@pytest.fixture(scope="module")
def registry(spark):
    versions = [("orders-key", 1), ("orders-value", 1), ("orders-value", 3), ("orders-value", 2), ("plain", 1)]
    rows = [(s, v, i, f'"schema {s} {v}"') for i, (s, v) in enumerate(versions)]
    return spark.createDataFrame(rows, "subject string, version int, id int, schema string")


def test_registry_reports(spark, registry):
    assert {r["subject"]: r["version"] for r in R.latest(registry).collect()} == {"orders-key": 1, "orders-value": 3, "plain": 1}
    assert {r["line"] for r in R.version_text(registry).collect()} == {"  orders-key: [1]", "  orders-value: [1,2,3]", "  plain: [1]"}
    assert [tuple(r) for r in R.sorted_kinds(registry).collect()] == [("key", "orders"), ("other", "plain"), ("value", "orders")]
    pair = R.previous_pairs(registry.union(registry)).collect()
    assert [(r["subject"], r["previous_version"], r["latest_version"]) for r in pair] == [("orders-value", 2, 3)]


def test_topics_join_their_subjects(spark, registry):
    topics = spark.createDataFrame([("orders",), ("orders-value",), ("plain",), ("none",)], "topic string")
    found = {r["topic"]: r for r in R.topic_subjects(topics, registry).collect()}
    assert set(found) == {"orders", "plain", "none"}
    assert (found["orders"]["key"]["version"], found["orders"]["value"]["version"], found["orders"]["other"]) == (1, 3, None)
    assert found["plain"]["other"]["subject"] == "plain" and found["none"]["key"] is None


# --- publishing


def template(spark, **values):
    base = {"data": '{"data":"value-{{i}}","n":1}', "config": "", "key": '"record-{{i}}"', "repeat": 0, "partition": None, "topic_override": None, "headers": {}}
    return spark.createDataFrame([tuple({**base, **values}.values())], publish.TEMPLATE)


@pytest.mark.parametrize("repeat, count", [(0, 1), (1, 1), (-3, 1), (2, 2), (150_000, 150_000)])
def test_repeats(spark, repeat, count):
    made = publish.repeat(template(spark, repeat=repeat), spread=repeat > 10)
    row = made.agg(F.count("*"), F.min("index"), F.max("index"), F.count_distinct("index")).first()
    assert tuple(row) == (count, 0, count - 1, count)


def test_published_records(spark):
    made = publish.records(template(spark, repeat=2, partition=0, headers={"h{{i}}": "v{{i}}", "h": "1"}), "my*topic")
    rows = sorted(made.collect(), key=lambda r: bytes(r["key"]))
    assert [(r["topic"], bytes(r["key"]), bytes(r["value"]), r["partition"]) for r in rows] == [
        ("myanytopic", b"record-0", b'{"data":"value-0","n":1}', 0), ("myanytopic", b"record-1", b'{"data":"value-1","n":1}', 0)
    ]
    assert {h["key"]: bytes(h["value"]) for h in rows[1]["headers"]} == {"h1": b"v1", "h": b"1"}


def test_colliding_header_names_keep_the_last(spark):
    made = publish.fill(publish.repeat(template(spark, headers={"a{{i}}": "x", "a0": "y"})))
    assert made.first()["headers"] == {"a0": "y"}


@pytest.mark.parametrize("data", [None, "null", '""', '"  "', "", "  "])
def test_tombstones_publish_no_value(spark, data):
    row = publish.records(template(spark, data=data, topic_override="bar"), "t").first()
    assert row["value"] is None and row["topic"] == "bar" and row["partition"] is None


# --- keyed documents


def test_keyed_documents(spark):
    log = spark.createDataFrame(
        [(1, "key/1", "put", "hello"), (2, "key/1", "put", "updated"), (3, "key/3", "put", "three"), (4, "key/4", "put", "x"),
         (5, "key/4", "delete", None), (6, "key/4", "delete", None), (7, "key/4", "put", "y"), (8, "key/4", "delete", None), (9, "key/a/b", "put", "z")],
        "seq bigint, path string, op string, body string",
    )
    assert [r["status"] for r in keyed.outcomes(log, width=2).orderBy("seq").collect()] == [201, 200, 201, 201, 200, 410, 201, 200, 201]
    now = keyed.current(log)
    assert {r["path"]: r["body"] for r in now.collect()} == {"key/1": "updated", "key/3": "three", "key/a/b": "z"}
    asked = spark.createDataFrame([("key/1",), ("missing",)], "path string")
    assert {r["path"]: (r["status"], r["body"]) for r in keyed.lookup(asked, now).collect()} == {"key/1": (200, "updated"), "missing": (410, None)}
    listed = lambda p: {tuple(r) for r in keyed.listing(now, p).collect()}
    assert listed("key") == {("leaf", "key/1"), ("leaf", "key/3"), ("dir", "a")}
    assert listed("") == {("dir", "key")} and listed("key/1") == {("leaf", "key/1")} and listed("ke") == set()


# --- scripts


def test_script_on_one_message(spark):
    good = scripts.try_script(spark, "record.content:foo", '{"foo":"bar"}').first()
    assert (good["result"], good["success"], good["messages"]) == ('"bar"', True, [])
    bad = scripts.try_script(spark, "this doesn't compile", '{"foo":"bar"}').first()
    assert bad["success"] is False and "this doesn't compile" in bad["messages"][0]
    failing = scripts.try_script(spark, "1 / as_long(record.content:n, 0)", "{}").first()
    assert failing["success"] is False and failing["result"] is None


def test_blank_scripts_are_errors(spark):
    for build in (scripts.map_messages, scripts.filter_messages):
        with pytest.raises(ValueError, match="empty"):
            build(spark.range(1), "  ")


def test_config_templates(spark):
    config = {
        "test.arr": "{{ array_join(transform(each(record.content:values), v -> v::string), ';') }}-{{ as_text(record.key) }}-{{ env.envi }}",
        "test.const": "some content",
        "x": "{{ as_text(record.content:foo) }}",
    }
    row = scripts.try_config(spark, config, '{"foo":"bar","values":[0,1,2]}', '"schlussel"', {"envi": "ronment"}).first()
    assert row["messages"] == [] and row["result"] == {"test.arr": "0;1;2-schlussel-ronment", "test.const": "some content", "x": "bar"}
    broken = scripts.try_config(spark, {"broken": "{{ record.does not compile }}"}, "{}").first()
    assert broken["success"] is False and broken["messages"][0].startswith("didn't work w/ input: ")


ALPHA = {"content": {"some": "content"}, "key": {"id": "abc123"}, "timestamp": 123456789, "headers": {}, "topic": "topic-alpha", "offset": 12, "partition": 100}
BETA = {"content": {"some": "more content"}, "key": {"id": "def456"}, "timestamp": 987654321, "headers": {"head": "er"}, "topic": "topic-beta", "offset": 13, "partition": 7}


def test_handler_on_test_messages(spark):
    def handler(batch, context):
        context.console.err("seen")
        return scripts.log_lines(batch, F.concat(F.lit("publishing "), F.to_json("content"), F.lit(" to "), "topic"))

    row = scripts.try_handler(spark, handler, [json.dumps([ALPHA, BETA])]).first()
    assert row["success"] and row["messages"] == ["Success!"]
    assert set(row["stdout"]) == {'publishing {"some":"content"} to topic-alpha', 'publishing {"some":"more content"} to topic-beta'}
    assert row["stderr"] == ["seen", "seen"]


def test_failing_handler_on_test_messages(spark):
    def handler(batch, context):
        raise RuntimeError("boom")

    row = scripts.try_handler(spark, handler, [json.dumps(ALPHA)]).first()
    assert row["success"] is False and row["messages"][-1] == "boom"
    incomplete = scripts.try_handler(spark, lambda b, c: b, ['{"topic":"t"}']).first()
    assert incomplete["success"] is False


# --- statistics and tables


def test_http_result_texts(spark):
    def results(n):
        one = F.struct(F.struct(F.lit("u").alias("url")).alias("request"), F.struct(F.lit(200).alias("statusCode"), F.lit("b").alias("body")).alias("response"),
                       F.lit(None).cast("string").alias("error"))
        return F.slice(F.array(one, one), 1, n)

    row = spark.range(1).select(*[stats.results_text(results(n)) for n in (0, 1, 2)]).first()
    assert tuple(row) == ("0 requests: [\n\n]", "u yields 200", "2 requests: [\nu yields 200\nu yields 200\n]")


def test_record_coordinates(spark):
    row = spark.range(1).select(stats.coords(F.lit("t"), F.lit(1), F.lit(0), F.lit(None).cast("variant")).alias("a"),
                                stats.coords(F.lit("t"), F.lit(1), F.lit(0), F.parse_json(F.lit('{"id":1}'))).alias("b")).first()
    assert row["a"]["key"] == "NULL" and row["b"]["key"] == '{"id":1}'


def test_calls_that_hang_are_counted_and_end_the_sending(monkeypatch):
    monkeypatch.setattr(http_sink, "ABANDONED", 3)
    hang = threading.Event()
    request = {"method": "GET", "url": "u", "headers": [], "body": b""}
    before = threading.active_count()
    try:
        errors = [http_sink._send_one(request, lambda *a: hang.wait(), 1, 0.0, 0.05)["error"] for _ in range(6)]
        assert errors == ["TimeoutError: no response within 0.05 s"] * 3 + ["TooManyAbandoned: 3 calls have not come back"] * 3
        assert threading.active_count() == before + 3
    finally:
        hang.set()
    time.sleep(0.3)
    assert threading.active_count() <= before and http_sink._send_one(request, lambda *a: (200, ""), 1, 0.0, 1.0)["error"] is None


@pytest.mark.parametrize("order", ["id DESC", "name", "x DESC, id", "x, name DESC, id"])
def test_sorted_row_numbers_agree_with_a_window(spark, order):
    frame = spark.range(3000).selectExpr(
        "id", "md5(cast(id AS string)) AS name", "IF(id % 7 = 0, NULL, cast(pow(id % 50, 4) AS double)) AS x").repartition(5)
    columns = [F.desc(o.split()[0]) if o.endswith("DESC") else o for o in order.split(", ")]
    numbered = sql_tables.with_sorted_row_numbers(frame, *columns, parts=16)
    want = frame.selectExpr("id", f"row_number() OVER (ORDER BY {order}) AS n")
    assert {(r["id"], r["$row"]) for r in numbered.select("id", "`$row`").collect()} == {tuple(r) for r in want.collect()}
    assert sql_tables.with_sorted_row_numbers(frame.where("false"), *columns).count() == 0


def test_ranges_of_sorted_rows_are_even(spark):
    seen = {}
    real = sql_tables.range_of
    sql_tables.range_of = lambda *a: seen.setdefault("range", real(*a))
    try:
        frame = spark.range(50_000).selectExpr("id", "pow(id, 3) AS x")
        sql_tables.with_sorted_row_numbers(frame, F.desc("x"), parts=20)
    finally:
        sql_tables.range_of = real
    sizes = [r["count"] for r in frame.groupBy(seen["range"].alias("r")).count().collect()]
    assert len(sizes) == 20 and max(sizes) < 2 * 50_000 / 20


def test_row_numbers_in_any_order(spark):
    rows = [(i, n, a) for i in (10, 100) for a in (2, 3) for n in ("foo", "bar", "BAR")]
    frame = spark.createDataFrame(rows, "ID int, Name string, Amount int").repartition(4)
    numbered = sql_tables.with_sorted_row_numbers(frame, "id", F.desc("name"), "amount")
    assert set(numbered.columns) == {"id", "name", "amount", "$row"} and numbered.count() == 12
    ordered = [tuple(r) for r in numbered.orderBy("`$row`").select("id", "name", "amount").collect()]
    by_amount = sorted(rows, key=lambda r: r[2])
    expected = sorted(sorted(by_amount, key=lambda r: r[1], reverse=True), key=lambda r: r[0])
    assert ordered == expected and [r[0] for r in numbered.select("`$row`").orderBy("`$row`").collect()] == list(range(1, 13))


def test_sql_errors_surface(spark):
    with pytest.raises(PySparkException):
        sql_tables.sql_query(spark, "select * from no_such_table").collect()


def test_dynamic_columns_in_rules_are_parsed_once(spark, capsys):
    scripts.register_functions(spark)
    frame = spark.createDataFrame([('{"a":1}',)], "t string").select(codec.text_to_json(F.col("t")).alias("content"))
    kept = scripts.filter_messages(frame, "as_long(content:a, 0) = 1 or as_long(content:b, 0) = 1")
    kept.select(D.as_int(D.select(F.col("content"), "a"))).explain()
    assert capsys.readouterr().out.count("try_parse") <= 6


def test_objects_with_many_keys_have_a_schema(spark):
    found = schema.path_types(texts(spark, {str(i): 1 for i in range(2000)}), "t")
    assert found.count() == 2001
    assert len(schema.spark_schema(schema.fold(found)).fields) == 2000


def _any_json(draw, depth=0):
    kind = draw.randrange(9 if depth < 4 else 7)
    if kind == 7:
        return [_any_json(draw, depth + 1) for _ in range(draw.randrange(4))]
    if kind == 8 or not depth and draw.random() < 0.7:
        return {draw.choice(["a", "b", "a b", "é", "", "aType", "\U0001f600", "\uffff"]): _any_json(draw, depth + 1) for _ in range(draw.randrange(5))}
    return [None, True, 1, 2**40, 1.5, "s", {}][kind]


def test_avro_text_is_written_along_the_pairs_without_a_tree(spark, monkeypatch):
    for seed in range(60):
        draw = random.Random(seed)
        values = [_any_json(draw) for _ in range(draw.randrange(1, 12))]
        root, pairs = schema.Node(), {}
        for batch in schema._partial(True)(iter([pa.RecordBatch.from_arrays([pa.array([json.dumps(v) for v in values])], ["text"])])):
            for row in batch.to_pylist():
                root.add(row["path"], row["type"], row["n"])
                pairs.setdefault(tuple(row["path"]), []).append((row["type"], row["n"]))
        # as Spark sorts: NULL first, texts by their bytes
        ordered = sorted(pairs, key=lambda path: [(step is not None, (step or "").encode()) for step in path])
        rows = [(list(path), kind, n) for path in ordered for kind, n in pairs[path]]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.list_(pa.string()), pa.string(), pa.int64()))], ["path", "type", "n"])
        with monkeypatch.context() as patch:
            patch.setattr(schema, "Node", None)
            written = [b["schema"][0].as_py() for b in schema._written("object", "gen")(iter([batch]))]
        assert written == [schema.avro_json(root)]


def test_avro_text_of_a_table_equals_the_merged_tree(spark):
    values = [{"a": [1, "x"], "é": {"b": 1}}, {"a": {"é": None}, "\uffff": 1, "\U0001f600": 2}, [1], 7]
    found = texts(spark, *values)
    assert schema.schema_text(found, "t").first()["schema"] == schema.schema_text(found, "t", schema.avro_json).first()["schema"]
    none = found.where("false")
    assert schema.schema_text(none, "t").collect() == schema.schema_text(none, "t", schema.avro_json).collect()


def test_a_request_without_response_is_a_failure(spark):
    rows = spark.sql("""SELECT array(
        struct(struct('http://a' AS url) AS request, struct(200 AS statusCode) AS response, CAST(NULL AS STRING) AS error),
        struct(struct('http://b' AS url) AS request, CAST(NULL AS STRUCT<statusCode: INT>) AS response, 'TimeoutError: late' AS error),
        struct(struct('http://c' AS url) AS request, CAST(NULL AS STRUCT<statusCode: INT>) AS response, NULL AS error)) AS results""")
    assert rows.select(stats.all_ok(F.col("results"))).first()[0] is False
    failed = stats.rest_failures(rows).first()["error"]
    assert "http://a yields 200\nError: TimeoutError: late\nError: no response from http://c" in failed


def test_blank_text_of_any_kind_is_a_tombstone(spark):
    from sluice import envelope

    rows = spark.sql("SELECT parse_json(x) AS c FROM VALUES ('\"\\\\t\\\\n\"'), ('\" \"'), ('null'), ('\"x\"'), ('0') AS t(x)")
    assert [r[0] for r in rows.select(envelope.tombstone(F.col("c"))).collect()] == [True, True, True, False, False]


def test_many_requests_take_few_threads(monkeypatch):
    started = []
    start = threading.Thread.start
    monkeypatch.setattr(threading.Thread, "start", lambda thread: (started.append(thread), start(thread)))
    messages = [[{"method": "GET", "url": str(i), "headers": [], "body": b""}] * (i % 3) for i in range(1000)]
    found = http_sink._Sending(messages, lambda method, url, headers, body: (200, url), 1, 0.0, 30.0).all(4)
    assert [[r[0][1] for r in sent] for sent in found] == [[str(i)] * (i % 3) for i in range(1000)] and len(started) == 4


def test_a_hanging_request_leaves_the_others_their_turn():
    hang, calls = threading.Event(), []

    def transport(method, url, headers, body):
        calls.append(url)
        if url == "hang" and calls.count(url) < 3:
            hang.wait()
        return 200, url

    messages = [[{"method": "GET", "url": u, "headers": [], "body": b""} for u in urls] for urls in (["a", "hang", "b"], ["c"], [], ["d"])]
    try:
        found = http_sink._Sending(messages, transport, 3, 0.0, 0.1).all(1)
    finally:
        hang.set()
    assert [[(r[0][1], r[1], r[2]) for r in sent] for sent in found] == [
        [("a", None, 1), ("hang", None, 3), ("b", None, 1)], [("c", None, 1)], [], [("d", None, 1)]]


def test_null_requests_are_results_too(spark):
    frame = spark.sql("""SELECT 1 AS i, array(named_struct('method', 'GET', 'url', 'u', 'headers', map('a', 'b'), 'body', CAST('x' AS BINARY)), NULL) AS r
                         UNION ALL SELECT 2, NULL UNION ALL SELECT 3, array()""").coalesce(1)
    sent = {r["i"]: r["results"] for r in http_sink.post_all(frame, "r", lambda m, u, h, b: (200, h["a"])).collect()}
    assert sent[2] == [] and sent[3] == [] and (sent[1][0]["response"]["body"], sent[1][0]["request"]["headers"]) == ("b", {"a": "b"})
    assert sent[1][1]["request"] is None and sent[1][1]["error"].startswith("TypeError")


def test_requests_are_made_by_all_cores(spark, sf_dir):
    from sluice.plans import publishing

    assert publishing._requests(spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def _answers(method, url, headers, body):
    if "hang" in url:
        time.sleep(600)
    if "raise" in url:
        raise ConnectionError("refused")
    return (500 if "bad" in url else 200), "body"


def test_requests_that_hang_raise_or_are_refused_are_failures(spark):
    urls = ["http://ok", "http://hang", "http://raise", "http://bad"]
    frame = spark.createDataFrame([(u, [("POST", u, {}, b"x")]) for u in urls],
                                  "u string, requests array<struct<method:string,url:string,headers:map<string,string>,body:binary>>")
    sent = http_sink.post_all(frame, "requests", _answers, timeout=1.0)
    seen = {r["u"]: r for r in sent.select("u", "results", stats.all_ok(F.col("results")).alias("ok"),
                                           F.to_json(stats.results_json(F.col("results"))).alias("json")).collect()}
    assert {u: r["ok"] for u, r in seen.items()} == {"http://ok": True, "http://hang": False, "http://raise": False, "http://bad": False}
    assert seen["http://hang"]["results"][0]["error"] == "TimeoutError: no response within 1 s"
    assert seen["http://raise"]["results"][0]["error"] == "ConnectionError: refused"
    assert json.loads(seen["http://raise"]["json"]) == {"error": "ConnectionError: refused"} and set(json.loads(seen["http://bad"]["json"])) == {"request", "response"}


def test_random_topic_has_a_name_of_its_own():
    first, second = TopicConfig("<random>"), TopicConfig("<random>")
    assert first.topic.startswith("topic") and first.topic != second.topic and first.kafka_options()["subscribe"] == first.topic


def test_database_queries_are_read_in_parts():
    assert sql_tables.jdbc_options("jdbc:x", "SELECT 1") == {"url": "jdbc:x", "query": "SELECT 1"}
    parts = sql_tables.jdbc_options("jdbc:x", "SELECT id FROM t", ("id", 0, 100, 4), driver="d")
    assert parts == {"url": "jdbc:x", "dbtable": "(SELECT id FROM t) q", "partitionColumn": "id", "lowerBound": "0", "upperBound": "100",
                     "numPartitions": "4", "driver": "d"}
