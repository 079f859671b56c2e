"""Queries over the dynamic accessors, on parts as JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sluice.functions import codec, dynamic as D
from sluice.functions.staging import once
from sluice.plans.catalog import query
from sluice.plans.inputs import PART_DOCS_SQL, part_documents


def _docs(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    return part_documents(spark, sf_dir, dealt).select("p_partkey", codec.text_to_json(F.col("doc")).alias("doc"))


WITH = f"WITH {PART_DOCS_SQL} "


@query("P-1", sql=WITH + """
SELECT p_partkey, doc->>'$.brand' AS brand, doc->>'$.info.type' AS part_type,
       coalesce(doc->>'$.info.nope.deeper', 'null') AS missing, coalesce(doc->>'$.name.x', 'null') AS through_text
FROM docs""")
def field_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("doc")
    return _docs(spark, sf_dir).select(
        "p_partkey",
        D.as_string(D.field(v, "brand")).alias("brand"),
        D.as_string(D.field(v, "info", "type")).alias("part_type"),
        D.as_string(D.field(v, "info", "nope", "deeper")).alias("missing"),
        D.as_string(D.field(v, "name", "x")).alias("through_text"),
    )


@query("P-2", sql=WITH + """
SELECT p_partkey, doc->>'$.dims[0]' AS first_dim, doc->>'$.dims[2]' AS last_dim,
       coalesce(doc->>'$.dims[3]', 'null') AS beyond, 'null' AS negative, coalesce(doc->>'$.name[0]', 'null') AS of_text,
       coalesce(doc->>'$.parts[1].no', 'null') AS second_no
FROM docs""")
def index_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("doc")
    dims = D.select(v, "dims")
    return _docs(spark, sf_dir).select(
        "p_partkey",
        D.as_string(D.item(dims, 0)).alias("first_dim"),
        D.as_string(D.item(dims, 2)).alias("last_dim"),
        D.as_string(D.item(dims, 3)).alias("beyond"),
        D.as_string(D.item(dims, -1)).alias("negative"),
        D.as_string(D.field(v, "name", 0)).alias("of_text"),
        D.as_string(D.field(v, "parts", 1, "no")).alias("second_no"),
    )


@query("P-4", sql=WITH + """
SELECT p_partkey, coalesce(doc->>'$.mix', 'null') AS mix, CAST(doc->'$.dims' AS VARCHAR) AS dims FROM docs""")
def text_of_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("doc")
    return _docs(spark, sf_dir).select(
        "p_partkey", D.as_string(D.field(v, "mix")).alias("mix"), D.as_string(D.field(v, "dims")).alias("dims")
    )


_INTEGRAL = "json_type(doc, '$.mix') IN ('UBIGINT', 'BIGINT', 'HUGEINT', 'UHUGEINT')"
_IS_INT = f"{_INTEGRAL} AND TRY_CAST(doc->>'$.mix' AS DOUBLE) BETWEEN -2147483648 AND 2147483647"
_TO_INT = "CAST(doc->>'$.mix' AS INTEGER)"


@query("P-5", sql=WITH + f"""
SELECT p_partkey, CASE WHEN {_IS_INT} THEN {_TO_INT} END AS int_opt, CASE WHEN {_IS_INT} THEN {_TO_INT} ELSE 0 END AS int_or_zero,
       CASE WHEN {_IS_INT} THEN {_TO_INT} ELSE -1 END AS int_or_minus_one
FROM docs""")
def int_or_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = D.select(F.col("doc"), "mix")
    return _docs(spark, sf_dir).select(
        "p_partkey",
        D.as_int_opt(mix).alias("int_opt"),
        D.as_int(mix).alias("int_or_zero"),
        D.as_int(mix, -1).alias("int_or_minus_one"),
    )


_NUMBER = "json_type(doc, '$.mix') IN ('UBIGINT', 'BIGINT', 'HUGEINT', 'UHUGEINT', 'DOUBLE')"


@query("P-6", sql=WITH + f"""
SELECT p_partkey, CASE WHEN {_NUMBER} THEN CAST(doc->>'$.mix' AS DOUBLE) END AS double_opt,
       CASE WHEN {_NUMBER} THEN CAST(doc->>'$.mix' AS DOUBLE) ELSE 0.5 END AS double_or_half
FROM docs""")
def double_or_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = D.select(F.col("doc"), "mix")
    return _docs(spark, sf_dir).select(
        "p_partkey", D.as_double_opt(mix).alias("double_opt"), D.as_double(mix, 0.5).alias("double_or_half")
    )


@query("P-7", sql=WITH + """
SELECT p_partkey, json_type(doc, '$.mix') = 'BOOLEAN' AND doc->>'$.mix' = 'true' AS flag,
       NOT (json_type(doc, '$.mix') = 'BOOLEAN') OR doc->>'$.mix' = 'true' AS flag_or_true
FROM (SELECT p_partkey, CASE WHEN json_type(doc, '$.mix') IS NULL THEN CAST('{"mix":null}' AS JSON) ELSE doc END AS doc FROM docs)""")
def bool_or_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = D.select(F.col("doc"), "mix")
    return _docs(spark, sf_dir).select(
        "p_partkey", D.as_bool(mix).alias("flag"), D.as_bool(mix, True).alias("flag_or_true")
    )


@query("P-8", sql=WITH + """
SELECT p_partkey, CAST(doc->>'$.info.cents' AS BIGINT) AS cents, doc->>'$.info.type' AS part_type,
       CASE WHEN json_type(doc, '$.mix') = 'ARRAY' THEN len(json_extract(doc, '$.mix[*]')) END AS mix_size,
       CASE WHEN coalesce(json_type(doc, '$.mix'), 'NULL') <> 'ARRAY'
            THEN 'cannot decode as array<int>: ' || coalesce(doc->>'$.mix', 'null') END AS mix_error
FROM docs""")
def typed_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = T.StructType([T.StructField("cents", T.LongType(), False), T.StructField("type", T.StringType(), False)])
    decoded = _docs(spark, sf_dir).select(
        "p_partkey",
        D.decode(D.field(F.col("doc"), "info"), info).alias("info"),
        D.decode(D.field(F.col("doc"), "mix"), T.ArrayType(T.IntegerType())).alias("mix"),
    )
    return decoded.select(
        "p_partkey",
        F.col("info.value.cents").alias("cents"),
        F.col("info.value.type").alias("part_type"),
        F.when(F.col("mix.value").isNotNull(), F.size("mix.value")).cast("bigint").alias("mix_size"),
        F.col("mix.error").alias("mix_error"),
    )


@query("P-9", sql=WITH + """
SELECT p_partkey, CAST(part->>'$.no' AS INTEGER) AS part_no, CAST(len(json_extract(part, '$.nested[*]')) AS BIGINT) AS nested
FROM (SELECT p_partkey, unnest(json_extract(doc, '$.parts[*]')) AS part FROM docs)
UNION ALL
SELECT p_partkey, NULL, CAST(item AS BIGINT) FROM (SELECT p_partkey, unnest(json_extract(doc, '$.mix[*]')) AS item FROM docs
  WHERE json_type(doc, '$.mix') = 'ARRAY')""")
def each_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    parts = docs.select("p_partkey", F.explode(D.each(D.select(F.col("doc"), "parts"))).alias("part")).select(
        "p_partkey",
        D.as_int(D.select(F.col("part"), "no")).alias("part_no"),
        F.size(D.each(D.select(F.col("part"), "nested"))).cast("bigint").alias("nested"),
    )
    mixed = docs.select("p_partkey", F.explode(D.each(D.select(F.col("doc"), "mix"))).alias("item")).select(
        "p_partkey", F.lit(None).cast("int").alias("part_no"), D.as_long_opt(F.col("item")).alias("nested")
    )
    return parts.unionByName(mixed)


@query("P-10", sql=WITH + """
SELECT p_partkey, CASE WHEN json_type(item) = 'VARCHAR' THEN item->>'$' ELSE CAST(item AS VARCHAR) END AS item FROM (
  SELECT p_partkey, unnest(CASE WHEN json_type(doc, '$.mix') = 'ARRAY' THEN json_extract(doc, '$.mix[*]')
                                ELSE [coalesce(json_extract(doc, '$.mix'), CAST('null' AS JSON))] END) AS item FROM docs)""")
def vector_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _docs(spark, sf_dir).select("p_partkey", F.explode(D.as_vector(D.field(F.col("doc"), "mix"))).alias("item"))
    return items.select("p_partkey", D.as_string(F.col("item")).alias("item"))


@query("P-11", sql=WITH + """
SELECT p_partkey, part_no, CAST(n AS INTEGER) AS n FROM (
  SELECT p_partkey, CAST(part->>'$.no' AS INTEGER) AS part_no, unnest(json_extract(part, '$.nested[*]')) AS n FROM (
    SELECT p_partkey, unnest(json_extract(doc, '$.parts[*]')) AS part FROM docs))""")
def nested_flat_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _docs(spark, sf_dir).select("p_partkey", F.explode(D.each(D.select(F.col("doc"), "parts"))).alias("part"))
    numbers = parts.select(
        "p_partkey",
        D.as_int(D.select(F.col("part"), "no")).alias("part_no"),
        F.explode(D.each(D.select(F.col("part"), "nested"))).alias("n"),
    )
    return numbers.select("p_partkey", "part_no", D.as_int(F.col("n")).alias("n"))


NESTED = 20


def _nested(inner: str) -> str:
    return "'" + '{"o":' * NESTED + "' || " + inner + " || '" + "}" * NESTED + "'"


@query("P-12", sql=WITH + f"""
SELECT p_partkey,
       '{{"cents":null,"extra":{{"key":' || p_partkey || '}},"type":"' || (doc->>'$.info.type') || '"}}' AS info,
       CASE json_type(doc, '$.mix') WHEN 'OBJECT' THEN '{{"a":1,"b":{{"c":2}}}}' ELSE '{{"b":{{"c":2}}}}' END AS mix,
       doc->>'$.name' AS name,
       {_nested("""'{"a":1.50,"b":"' || p_partkey || '","c":' || p_partkey || ',"d":{"e":2}}'""").replace("1.50", "1.5")} AS nested
FROM docs""")
def deep_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("doc")
    right = F.parse_json(
        F.concat(F.lit('{"info":{"cents":null,"extra":{"key":'), F.col("p_partkey").cast("string"), F.lit('}},"mix":{"b":{"c":2}}}'))
    )
    # objects that nest deeply on both sides and differ in the innermost only
    held = once(
        _docs(spark, sf_dir, dealt=True), right=right,
        left_deep=F.parse_json(F.expr(_nested("""'{"a":1.50,"b":"' || p_partkey || '","d":1}'"""))),
        right_deep=F.parse_json(F.expr(_nested("""'{"c":' || p_partkey || ',"d":{"e":2}}'"""))),
    )
    nested = F.to_json(D.deep_merge(F.col("left_deep"), F.col("right_deep"))).alias("nested")
    merged = once(held, doc=D.deep_merge(v, F.col("right")), nested=nested)
    return merged.select(
        "p_partkey",
        F.to_json(D.field(v, "info")).alias("info"),
        F.to_json(D.field(v, "mix")).alias("mix"),
        D.as_string(D.field(v, "name")).alias("name"),
        "nested",
    )
