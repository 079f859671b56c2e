import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F, types as T

from sluice import envelope
from sluice.functions import codec, dynamic as D


def text_rows(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")


@pytest.mark.parametrize(
    "text, expected",
    [
        ("hello", '"hello"'),
        ('{"hello":"world"}', '{"hello":"world"}'),
        ("123", "123"),
        ("1 2", '"1 2"'),
        ('{"a":1} {"b":2}', '"{\\"a\\":1} {\\"b\\":2}"'),
        ("1],[2", '"1],[2"'),
        ("1,2", '"1,2"'),
        (" 7 ", "7"),
        ("", '""'),
        ("{", '"{"'),
        ("NaN", '"NaN"'),
        ("'x'", "\"'x'\""),
        ('{"a":1,"a":2}', '{"a":2}'),
        (None, "null"),
        ("null", "null"),
    ],
)
def test_text_is_json_or_a_json_string(spark, text, expected):
    assert text_rows(spark, text).select(F.to_json(codec.text_to_json(F.col("t")))).first()[0] == expected


def test_bytes(spark):
    row = spark.range(1).select(
        F.to_json(codec.to_json_value(F.lit(b'{"a":1}'), T.BinaryType())),
        F.to_json(codec.to_json_value(F.unhex(F.lit("FF41")), T.BinaryType())),
        codec.to_text(F.lit(b"hello"), T.BinaryType()),
    ).first()
    assert tuple(row) == ('{"a":1}', '"�A"', "aGVsbG8=")


@pytest.mark.parametrize("value", [0, 1, -1, 2**63 - 1, -(2**63), 42])
def test_longs_round_trip(spark, value):
    data = codec.long_to_bytes(F.lit(value).cast("bigint"))
    row = spark.range(1).select(data, codec.long_from_bytes(data)).first()
    assert bytes(row[0]) == value.to_bytes(8, "big", signed=True)
    assert row[1] == value


@pytest.mark.parametrize(
    "name, wire",
    [("", "string"), ("Strings", "string"), ("longs", "long"), ("Byte Array", "bytes"), ("avro", "avro:gen"), ("avro:My", "avro:My"), ("json", "json")],
)
def test_wire_type_names(name, wire):
    assert codec.wire_type(name) == wire


def test_unknown_wire_type():
    with pytest.raises(ValueError, match="serializer"):
        codec.wire_type("protobuf")


def test_long_of_text_fails_the_row(spark):
    with pytest.raises(PySparkException, match="to a long"):
        text_rows(spark, '"x"').select(codec.serialise(codec.text_to_json(F.col("t")), "long")).collect()


def test_records_of_a_schema_as_a_wire_type(spark):
    frame = spark.createDataFrame([('"é"',), ('""',)], "t string").select(F.parse_json("t").alias("v"))
    made = frame.select(codec.serialise(F.col("v"), "avro:n", '"string"').alias("b"))
    assert [bytes(r["b"]) for r in made.collect()] == [b"\x04\xc3\xa9", b"\x00"]
    assert [r[0] for r in made.select(codec.deserialise(F.col("b"), "avro:n", '"string"').cast("string")).collect()] == ["é", ""]
    assert spark.range(1).select(codec.deserialise(F.lit(b"x"), "avro:n", '"string"')).first()[0] is None
    for use in (lambda: codec.deserialise(F.lit(b"x"), "avro"), lambda: codec.serialise(F.lit(None), "avro")):
        with pytest.raises(ValueError, match="schema"):
            use()


def test_last_duplicate_header_wins(spark):
    frame = spark.createDataFrame(
        [([("a", bytearray(b"1")), ("b", bytearray(b"2")), ("a", bytearray(b"3"))],), ([],), (None,)],
        "h array<struct<key string, value binary>>",
    )
    assert [r[0] for r in frame.select(codec.header_map(F.col("h"))).collect()] == [{"a": "3", "b": "2"}, {}, None]


def test_undecodable_records_become_error_objects(spark):
    frame = spark.createDataFrame(
        [
            (bytearray(b"k"), bytearray(b'{"a":1}'), "t", 0, 5),
            (None, bytearray(b'{"a'), "t", 0, 6),
            (bytearray(b"k"), None, "t", 0, 7),
        ],
        "key binary, value binary, topic string, partition int, offset bigint",
    ).withColumn("timestamp", F.timestamp_millis(F.lit(1704067200123)))
    rows = {r["offset"]: r for r in envelope.from_records(frame).select("*", F.to_json("content").alias("c")).collect()}
    assert json.loads(rows[5]["c"]) == {"a": 1} and rows[5]["timestamp"] == 1704067200123
    bad = json.loads(rows[6]["c"])
    assert (bad["offset"], bad["partition"], bad["topic"], bad["supportedType"], bad["valueString"]) == (6, 0, "t", "json", '{"a')
    assert rows[7]["c"] == "null"


MESSAGE = {"content": "value", "key": 3, "timestamp": 2**63 - 1, "headers": {"head": "er"}, "topic": "", "offset": 123, "partition": 456}


def test_envelope_round_trip(spark):
    line = json.dumps(MESSAGE)
    read = envelope.read_json(text_rows(spark, line), "t", "m").select("m.error", "m.value.*")
    back = read.select("error", envelope.to_json(read).alias("j")).first()
    assert back["error"] is None and json.loads(back["j"]) == MESSAGE


@pytest.mark.parametrize("field", list(MESSAGE))
def test_every_envelope_field_is_required(spark, field):
    line = json.dumps({k: v for k, v in MESSAGE.items() if k != field})
    row = envelope.read_json(text_rows(spark, line), "t", "m").first()["m"]
    assert row["value"] is None and "cannot decode" in row["error"]


@pytest.mark.parametrize("text, gone", [("null", True), ('""', True), ('"  "', True), ('"x"', False), ("0", False), ("{}", False), ("[]", False)])
def test_tombstones(spark, text, gone):
    assert text_rows(spark, text).select(envelope.tombstone(F.parse_json("t"))).first()[0] is gone


@pytest.mark.parametrize("text, root", [("123", {"value": 123}), ("true", {"value": True}), ('"text"', {"value": "text"}), ("[1]", {"array": [1]}), ('{"a":1}', {"a": 1})])
def test_record_roots(spark, text, root):
    assert json.loads(text_rows(spark, text).select(F.to_json(codec.record_root(F.parse_json("t")))).first()[0]) == root


def test_nested_maps_parse_their_texts(spark):
    frame = spark.sql("select map('a', '1', 'b', 'x') m, array('1', 'q') a, named_struct('s', '1') s, cast('NaN' as double) d, date'2024-01-01' t")
    row = frame.select(*[F.to_json(codec.to_json_value(F.col(f.name), f.dataType)) for f in frame.schema]).first()
    assert [json.loads(x) for x in row][:4] == [{"a": 1, "b": "x"}, [1, "q"], {"s": "1"}, "NaN"]
    assert json.loads(row[4])["class"] == "date"


def test_decode_of_missing_value(spark):
    assert D.decode_as(spark.range(1), F.lit(None).cast("variant"), T.LongType(), "d").first()["d"]["error"] == "cannot decode as bigint: null"
