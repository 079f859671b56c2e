"""Queries over seeds, generated samples and uploaded documents. Seeds come from the tables' keys."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from sluice.functions import seeds as S
from sluice.operators import datagen
from sluice.plans.catalog import query
from sluice.plans.inputs import REGISTRY_SQL, registry, table

# Fixed value: a schema whose samples for seeds 123 and 456 are known.
EXAMPLE = json.dumps(
    [
        {
            "namespace": "example",
            "type": "record",
            "name": "Example",
            "fields": [
                {"name": "id", "type": "string", "default": ""},
                {
                    "name": "addresses",
                    "type": {
                        "type": "array",
                        "items": {
                            "name": "Address",
                            "type": "record",
                            "fields": [
                                {"name": "name", "type": "string"},
                                {"name": "lines", "type": {"type": "array", "items": "string"}},
                            ],
                        },
                    },
                },
                {"name": "someText", "type": "string", "default": ""},
                {"name": "someLong", "type": "long", "default": 0},
                {"name": "someDouble", "type": "double", "default": 1.23},
                {"name": "someInt", "type": "int", "default": 123},
                {"name": "someFloat", "type": "float", "default": 1.0},
                {
                    "name": "day",
                    "type": {
                        "name": "daysOfTheWeek",
                        "type": "enum",
                        "symbols": ["MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY", "SUNDAY"],
                    },
                    "default": "MONDAY",
                },
            ],
        }
    ]
)

# Every type in one record, with an optional field, a map, bytes, a fixed and a nested union.
EVERY_TYPE = json.dumps(
    {
        "type": "record",
        "name": "Every",
        "fields": [
            {"name": "flag", "type": "boolean"},
            {"name": "nothing", "type": "null"},
            {"name": "kind", "type": {"type": "enum", "name": "Kind", "symbols": ["A", "B", "C"]}},
            {"name": "maybe", "type": ["null", "int"]},
            {"name": "raw", "type": "bytes"},
            {"name": "hash", "type": {"type": "fixed", "name": "Hash", "size": 16}},
            {"name": "counts", "type": {"type": "map", "values": "long"}},
            {"name": "again", "type": "Kind"},
            {"name": "last", "type": "long"},
        ],
    }
)

TWO64 = "18446744073709551616"


def _unsigned(text: str) -> str:
    return f"(CASE WHEN {text} >= 9223372036854775808 THEN {text} - {TWO64} ELSE {text} END)"


def _seed_sql(seed: str, draws: int) -> str:
    """The seed after some draws, by the same closed form over 128-bit integers.

    The constant is split in 32-bit halves so that no product leaves 128 bits.
    """
    a, c = S.jump(draws)
    high, low = a >> 32, a & 0xFFFFFFFF
    big = f"CAST({seed} AS HUGEINT)"
    return f"((((({big} * {high}) % 4294967296) * 4294967296) + {big} * {low} + {c}) % {TWO64})"


def _signed_sql(seed: str, draws: int) -> str:
    return f"CAST({_unsigned(_seed_sql(seed, draws))} AS BIGINT)"


@query("G-2", sql=f"""
SELECT o_orderkey, {_signed_sql("o_orderkey", 1)} AS next_seed, {_signed_sql("o_orderkey", 2)} AS second_seed,
       {_signed_sql("o_orderkey", 12)} AS twelfth_seed FROM orders""")
def seed_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", S.next_seed(seed).alias("next_seed"))
    return orders.select(
        "o_orderkey", "next_seed", S.next_seed(F.col("next_seed")).alias("second_seed"), S.advance(seed, 12).alias("twelfth_seed")
    )


@query("G-3", sql=f"""
SELECT o_orderkey, CAST(abs(CAST(s AS HUGEINT)) % 7 AS INTEGER) AS day, CAST(abs(CAST(s AS HUGEINT)) % 1001 AS INTEGER) AS thousand,
       0 AS nothing, CAST(abs(CAST(s AS HUGEINT)) % 11 AS INTEGER) AS of_negative
FROM (SELECT o_orderkey, {_signed_sql("o_orderkey", 1)} AS s FROM orders)""")
def bounded_ints(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s")
    drawn = table(spark, sf_dir, "orders").select("o_orderkey", S.next_seed(F.col("o_orderkey")).alias("s"))
    return drawn.select(
        "o_orderkey", S.bounded_int(s, 6).alias("day"), S.bounded_int(s, 1000).alias("thousand"),
        S.bounded_int(s, 0).alias("nothing"), S.bounded_int(s, -10).alias("of_negative"),
    )


@query("G-4", sql=f"""
SELECT o_orderkey, s AS drawn, round(u, 9) AS unit, s > 0 AS positive, u < 0.25 AS quarter
FROM (SELECT o_orderkey, s, abs(CAST(s AS DOUBLE) / 9223372036854775807.0::DOUBLE) AS u FROM (
  SELECT o_orderkey, {_signed_sql("o_orderkey", 3)} AS s FROM orders))""")
def random_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s")
    drawn = table(spark, sf_dir, "orders").select("o_orderkey", S.advance(F.col("o_orderkey"), 3).alias("s"))
    return drawn.select(
        "o_orderkey", s.alias("drawn"), F.round(S.unit_double(s), 9).alias("unit"), S.positive(s).alias("positive"),
        S.weighted_boolean(s, 0.25).alias("quarter"),
    )


def _low_int(s: str) -> str:
    return f"CAST(CASE WHEN ({s} & 4294967295) >= 2147483648 THEN ({s} & 4294967295) - 4294967296 ELSE ({s} & 4294967295) END AS INTEGER)"


def _text(s: str) -> str:
    return f"lower(to_hex({s}))"


_DAYS = next(f["type"]["symbols"] for f in json.loads(EXAMPLE)[0]["fields"] if f["name"] == "day")


@query("G-1", sql="""
SELECT o_orderkey, """ + _text("s0") + " AS id, " + _text("s1") + " AS first_name, " + _text("s6") + f""" AS second_line,
       s8 AS some_long, CAST(s9 AS DOUBLE) AS some_double, {_low_int("s10")} AS some_int, CAST(CAST(s11 AS FLOAT) AS DOUBLE) AS some_float,
       {_DAYS}[1 + CAST(abs(CAST(s12 AS HUGEINT)) % 7 AS INTEGER)] AS day
FROM (SELECT o_orderkey, {", ".join(f"{_signed_sql('o_orderkey', k)} AS s{k}" for k in (0, 1, 6, 8, 9, 10, 11, 12))} FROM orders)""")
def example_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "orders").select("o_orderkey", datagen.sample(EXAMPLE, F.col("o_orderkey")).alias("r"))
    return made.select(
        "o_orderkey", "r.id", F.col("r.addresses")[0]["name"].alias("first_name"), F.col("r.addresses")[1]["lines"][1].alias("second_line"),
        F.col("r.someLong").alias("some_long"), F.col("r.someDouble").alias("some_double"), F.col("r.someInt").alias("some_int"),
        F.col("r.someFloat").cast("double").alias("some_float"), "r.day",
    )


@query("G-1", sql=f"""
SELECT o_orderkey, (s0 % 7) % 2 = 0 AS flag, CAST(NULL AS VARCHAR) AS nothing, ['A', 'B', 'C'][1 + CAST(abs(CAST(s1 AS HUGEINT)) % 3 AS INTEGER)] AS kind,
       {_low_int("s1")} AS maybe, {_low_int("s2")} AS raw, {_low_int("s3")} AS hash, s6 AS first_count, s7 AS second_count,
       ['A', 'B', 'C'][1 + CAST(abs(CAST(s8 AS HUGEINT)) % 3 AS INTEGER)] AS again, s8 AS last
FROM (SELECT o_orderkey, {", ".join(f"{_signed_sql('o_orderkey', k)} AS s{k}" for k in (0, 1, 2, 3, 4, 5, 6, 7, 8))} FROM orders)""")
def every_type_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "orders").select("o_orderkey", datagen.sample(EVERY_TYPE, F.col("o_orderkey")).alias("r"))
    return made.select(
        "o_orderkey", "r.flag", "r.nothing", "r.kind", "r.maybe", F.col("r.raw")[0].alias("raw"), "r.hash",
        F.map_values("r.counts")[0].alias("first_count"), F.map_values("r.counts")[1].alias("second_count"), "r.again", "r.last",
    )


@query("G-7", sql=f"""WITH {REGISTRY_SQL}
SELECT subject, version, '{{"id":' || id || ',"n' || version || '":' || {_low_int(_signed_sql("id", 1))} || '}}' AS sample
FROM registry WHERE version % 7 <> 0""")
def registry_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = datagen.registry_samples(registry(spark, sf_dir), F.col("id").cast("bigint"))
    return made.select("subject", "version", "sample")


@query("S-7", sql=f"""
SELECT o_orderkey, format, CASE format WHEN 'json' THEN '{{"order":' || o_orderkey || '}}'
         WHEN 'avro' THEN '{{"id":' || o_orderkey || ',"last":' || {_signed_sql("o_orderkey", 1)} || '}}' END AS document,
       CASE WHEN format IS NULL THEN 'Couldn''t parse content as avro or json: >order = ' || o_orderkey || '<' END AS parse_error
FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'avro' WHEN 1 THEN 'json' END AS format FROM orders)""")
def parsed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = '{"type":"record","name":"R","fields":[{"name":"id","type":"long"},{"name":"last","type":"long"}]}'
    key = F.col("o_orderkey").cast("string")
    text = (
        F.when(F.col("o_orderkey") % 3 == 0, F.lit(schema))
        .when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit('{"order":'), key, F.lit("}")))
        .otherwise(F.concat(F.lit("order = "), key))
    )
    uploads = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    return datagen.parse_documents(uploads, "text", F.col("o_orderkey")).drop("text")
