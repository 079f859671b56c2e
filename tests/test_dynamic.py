import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F, types as T

from sluice import session
from sluice.functions import codec, dynamic as D

NESTED = json.dumps(
    {"hello": {"there": True, "world": [{"name": "first", "nested": [1, 2, 3]}, {"name": "second", "nested": [4, 5]}]}}
)


def docs(spark, *texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return frame.select("i", codec.text_to_json(F.col("t")).alias("v"))


def one(spark, text, build):
    return docs(spark, text).select(build(F.col("v"))).first()[0]


def test_nested_flat_map_reaches_all_numbers(spark):
    worlds = docs(spark, NESTED).select(F.explode(D.each(D.field(F.col("v"), "hello", "world"))).alias("w"))
    numbers = worlds.select(F.explode(D.each(D.field(F.col("w"), "nested"))).alias("n")).select(D.as_int(F.col("n")))
    assert [r[0] for r in numbers.collect()] == [1, 2, 3, 4, 5]


def test_missing_boolean_is_the_default(spark):
    assert one(spark, NESTED, lambda v: D.as_bool(D.field(v, "hello", "there"))) is True
    assert one(spark, NESTED, lambda v: D.as_bool(D.field(v, "hello", "nope"))) is False
    assert one(spark, NESTED, lambda v: D.as_bool(D.field(v, "hello", "nope"), True)) is True


@pytest.mark.parametrize(
    "text, as_int, as_long, as_double, as_bool",
    [
        ('"12"', None, None, None, False),
        ('"true"', None, None, None, False),
        ("1.5", None, None, 1.5, False),
        ("1.0", 1, 1, 1.0, False),
        ("1e3", 1000, 1000, 1000.0, False),
        ("2147483648", None, 2147483648, 2147483648.0, False),
        ("-2147483648", -2147483648, -2147483648, -2147483648.0, False),
        ("9223372036854775808", None, None, 9223372036854775808.0, False),
        ("null", None, None, None, False),
        ("true", None, None, None, True),
        ("[1]", None, None, None, False),
        ("{}", None, None, None, False),
    ],
)
def test_accessors_do_not_coerce(spark, text, as_int, as_long, as_double, as_bool):
    row = docs(spark, text).select(
        D.as_int_opt(F.col("v")), D.as_long_opt(F.col("v")), D.as_double_opt(F.col("v")), D.as_bool(F.col("v"))
    ).first()
    assert tuple(row) == (as_int, as_long, as_double, as_bool)


@pytest.mark.parametrize("name", ["a b", "x'y", 'q"q', "what?", "", "ü", "a.b", "back\\slash", "[0]", "it's \"both\""])
def test_any_field_name_can_be_selected(spark, name):
    assert one(spark, json.dumps({"o": {name: 7}}), lambda v: D.as_int(D.field(v, "o", name))) == 7
    assert one(spark, json.dumps({"o": {"z": 7}}), lambda v: D.as_string(D.field(v, "o", name))) == "null"


@pytest.mark.parametrize(
    "text, each, vector",
    [("[1,2]", 2, 2), ("[]", 0, 0), ("3", 0, 1), ("null", 0, 1), ('{"a":1}', 0, 1), ('"x"', 0, 1)],
)
def test_each_and_vector_differ_on_non_arrays(spark, text, each, vector):
    row = docs(spark, text).select(F.size(D.each(F.col("v"))), F.size(D.as_vector(F.col("v")))).first()
    assert tuple(row) == (each, vector)


def test_sql_null_reads_like_json_null(spark):
    frame = spark.range(1).select(F.lit(None).cast("variant").alias("v"))
    row = frame.select(
        D.as_string(F.col("v")), D.as_int(F.col("v")), F.size(D.each(F.col("v"))), F.size(D.as_vector(F.col("v"))), D.is_null(F.col("v"))
    ).first()
    assert tuple(row) == ("null", 0, 0, 1, True)


@pytest.mark.parametrize(
    "left, right, merged",
    [
        ('{"a":1,"b":{"c":1,"d":{"e":1}}}', '{"a":null,"b":{"d":{"f":2}}}', {"a": None, "b": {"c": 1, "d": {"e": 1, "f": 2}}}),
        ("3", '{"a":1}', {"a": 1}),
        ('{"a":1}', "3", 3),
        ('{"a":[1]}', '{"a":[2]}', {"a": [2]}),
        ("{}", "{}", {}),
        ('{"a":{"b":1}}', "null", None),
    ],
)
def test_deep_merge(spark, left, right, merged):
    frame = spark.createDataFrame([(left, right)], "l string, r string")
    assert json.loads(frame.select(F.to_json(D.deep_merge(F.parse_json("l"), F.parse_json("r")))).first()[0]) == merged


@pytest.mark.parametrize("levels", [1, 5, 20, 300])
def test_deep_merge_at_any_depth(spark, levels):
    def nest(inner):
        for i in range(levels):
            inner = {"o": inner, f"k{i}": [i, {"x": "}"}]}
        return inner

    left, right = nest({"a": 1, "b": {"c": 1}, 'q"\\{': "{"}), nest({"b": {"d": None}, "a": {"z": 1.25}, "é": ["\\", '"']})
    frame = spark.createDataFrame([(json.dumps(left), json.dumps(right)), ("1", "{}"), ("{}", "{}")], "l string, r string")
    got = [json.loads(r[0]) for r in frame.select(F.to_json(D.deep_merge(F.parse_json("l"), F.parse_json("r")))).collect()]
    assert got == [nest({"a": {"z": 1.25}, "b": {"c": 1, "d": None}, 'q"\\{': "{", "é": ["\\", '"']}), {}, {}]


def test_merged_text_keeps_the_spelling_of_numbers():
    assert D.merged_text('{"a":{"b":1.10,"c":{}}}', '{"a":{"c":{"d":12345678901234567890123}},"e":[]}') == (
        '{"a":{"b":1.10,"c":{"d":12345678901234567890123}},"e":[]}')
    assert D.merged_text("{}", "{}") == "{}" and D.merged_text('{"a":1}', "{}") == '{"a":1}' == D.merged_text("{}", '{"a":1}')


SCHEMA = T.StructType(
    [
        T.StructField("a", T.IntegerType(), False),
        T.StructField("b", T.ArrayType(T.StringType())),
        T.StructField("m", T.MapType(T.StringType(), T.DoubleType())),
    ]
)


@pytest.mark.parametrize(
    "text, good",
    [
        ('{"a":1}', True),
        ('{"a":1,"b":null}', True),
        ('{"a":1e3,"b":["x"],"m":{"k":1.5}}', True),
        ('{"a":"1"}', False),
        ('{"b":[]}', False),
        ('{"a":1,"b":[1]}', False),
        ('{"a":1,"m":{"k":"v"}}', False),
        ("[]", False),
        ("null", False),
    ],
)
def test_typed_decode_is_strict(spark, text, good):
    result = docs(spark, text).select(D.decode(F.col("v"), SCHEMA).alias("d")).first()["d"]
    assert (result["value"] is not None, result["error"] is None) == (good, good)
    staged = D.decode_as(docs(spark, text), F.col("v"), SCHEMA, "d").first()["d"]
    assert staged == result


def test_deep_merge_of_one_file_uses_all_cores(spark):
    from sluice.plans import navigation

    base = session.shared_dir(spark, "parts")
    spark.range(100).selectExpr("id AS p_partkey", "'n' AS p_name", "'b' AS p_brand", "'t' AS p_type", "1 AS p_size", "1.5 AS p_retailprice").coalesce(
        1).write.parquet(f"{base}/part.parquet")
    made = navigation.deep_merge(spark, base)
    assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and made.count() == 100
