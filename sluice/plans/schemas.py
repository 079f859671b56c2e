"""Queries over inferred schemas and the schema registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sluice.functions import dynamic as D, text as X
from sluice.operators import registry as R, schema
from sluice.plans.catalog import query
from sluice.plans.inputs import PART_DOCS_SQL, REGISTRY_SQL, part_documents, registry, table

_TYPE = """CASE json_type({v}) WHEN 'OBJECT' THEN 'RECORD' WHEN 'ARRAY' THEN 'ARRAY' WHEN 'VARCHAR' THEN 'STRING' WHEN 'BOOLEAN' THEN 'BOOLEAN'
  WHEN 'NULL' THEN 'NULL' WHEN 'DOUBLE' THEN 'DOUBLE' ELSE CASE WHEN TRY_CAST({v}->>'$' AS BIGINT) <= 2147483647 THEN 'INT' ELSE 'LONG' END END"""


def _typed(v: str) -> str:
    return _TYPE.format(v=v)


VALUES_SQL = f"""WITH {PART_DOCS_SQL},
vals AS (
  SELECT '$' AS path, doc AS v FROM docs
  UNION ALL SELECT '$.' || k, json_extract(doc, '$.' || k) FROM docs, (SELECT unnest(['brand', 'dims', 'info', 'mix', 'name', 'parts']) AS k)
  UNION ALL SELECT '$.info.' || k, json_extract(doc, '$.info.' || k) FROM docs, (SELECT unnest(['cents', 'type']) AS k)
  UNION ALL SELECT '$.mix.a', json_extract(doc, '$.mix.a') FROM docs
  UNION ALL SELECT '$.dims[]', unnest(json_extract(doc, '$.dims[*]')) FROM docs
  UNION ALL SELECT '$.mix[]', unnest(json_extract(doc, '$.mix[*]')) FROM docs WHERE json_type(doc, '$.mix') = 'ARRAY'
  UNION ALL SELECT '$.parts[]', unnest(json_extract(doc, '$.parts[*]')) FROM docs
  UNION ALL SELECT '$.parts[].' || k, json_extract(p, '$.' || k) FROM (SELECT unnest(json_extract(doc, '$.parts[*]')) AS p FROM docs),
                                                                  (SELECT unnest(['nested', 'no']) AS k)
  UNION ALL SELECT '$.parts[].nested[]', unnest(json_extract(p, '$.nested[*]')) FROM (SELECT unnest(json_extract(doc, '$.parts[*]')) AS p FROM docs))
"""


@query("A-5", "X-11", sql=VALUES_SQL + f"SELECT path, {_typed('v')} AS type, count(*) AS n FROM vals WHERE v IS NOT NULL GROUP BY ALL")
def json_path_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = schema.path_types(part_documents(spark, sf_dir), "doc")
    return found.select(schema.path_text(F.col("path")).alias("path"), "type", "n")


@query("A-5", "X-11", sql="""
SELECT '{"type": "record", "name": "object", "namespace": "gen", "fields": [{"name": "depth", "type": {"type": "record", "name": "depthType", "namespace": "gen", "fields": ['
  || string_agg('{"name": "k' || k || '", "type": ["null", ' || CASE WHEN big THEN '"int", "long"' ELSE '"int"' END || ']}', ', ' ORDER BY 'k' || k)
  || ']}}]}' AS schema
FROM (SELECT o_custkey AS k, max(o_orderkey % 3) = 2 AND min(o_orderkey % 3) = 2 AS only_big, bool_or(o_orderkey % 3 = 2) AS big, bool_or(o_orderkey % 3 <> 2) AS small
      FROM orders GROUP BY o_custkey) WHERE small""")
def schema_of_data_as_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that have customers for keys: the schema has a field for each and stays in Spark."""
    orders = table(spark, sf_dir, "orders")
    small = orders.where("o_orderkey % 3 <> 2").select("o_custkey").distinct().withColumn("_seen", F.lit(True))
    kept = orders.join(small, "o_custkey", "left_semi")
    value = F.when(F.col("o_orderkey") % 3 == 2, F.lit(4000000000)).otherwise(F.lit(1).cast("bigint")).cast("string")
    text = F.concat(F.lit('{"depth":{"k'), F.col("o_custkey").cast("string"), F.lit('":'), value, F.lit("}}"))
    return schema.schema_text(kept.select(text.alias("doc")), "doc")


@query("A-5", "U-1", "X-20", sql=f"""WITH {PART_DOCS_SQL}
SELECT p_partkey, doc->>'$.brand' AS brand, CAST(doc->>'$.info.cents' AS BIGINT) AS cents, coalesce(doc->>'$.mix', 'null') AS mix,
       CAST(len(json_extract(doc, '$.parts[*]')) AS INTEGER) AS parts, CAST(doc->>'$.parts[0].nested[0]' AS INTEGER) AS nested
FROM docs""")
def read_with_inferred_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = part_documents(spark, sf_dir)
    merged = schema.spark_schema(schema.infer(docs, "doc"))
    r = F.col("record.value")
    read = schema.read_typed(docs, "doc", merged)
    return read.select(
        "p_partkey", r["brand"].alias("brand"), r["info"]["cents"].cast("bigint").alias("cents"), D.as_string(r["mix"]).alias("mix"),
        F.size(r["parts"]).alias("parts"), F.get(F.get(r["parts"], 0)["nested"], 0).alias("nested"),
    )


@query("U-1", sql="""
SELECT 'c' || c_custkey AS "key", c_acctbal AS balance, c_mktsegment AS segment, NULL AS place, CAST(c_nationkey AS VARCHAR) AS nation FROM customer
UNION ALL SELECT 's' || s_suppkey, s_acctbal, NULL, 'n' || s_nationkey, 'n' || s_nationkey FROM supplier""")
def schema_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"),
    )
    nation = F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))
    right = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("key"), F.col("s_acctbal").alias("balance"),
        nation.alias("place"), nation.alias("nation"),
    )
    both = schema.union_all(left, right)
    return both.select("key", "balance", "segment", "place", D.as_string(F.col("nation")).alias("nation"))


WITH = f"WITH {REGISTRY_SQL} "


@query("A-6", sql=WITH + """
SELECT subject, version, id, schema FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY version DESC) AS r FROM registry) WHERE r = 1""")
def latest_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest(registry(spark, sf_dir))


@query("A-6", sql=WITH + "SELECT subject, count(DISTINCT version) AS versions, max(version) AS latest FROM registry GROUP BY subject")
def subject_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.summary(registry(spark, sf_dir))


@query("X-19", sql=WITH + """
SELECT subject, '  ' || subject || ': [' || string_agg(version, ',' ORDER BY version) || ']' AS line FROM registry GROUP BY subject""")
def version_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.version_text(registry(spark, sf_dir))


@query("A-7", "X-12", "W-4", sql=WITH + r"""
SELECT DISTINCT CASE WHEN subject LIKE '%-key' THEN 'key' WHEN subject LIKE '%-value' THEN 'value' ELSE 'other' END AS kind,
       regexp_replace(subject, '-(key|value)$', '') AS name FROM registry""")
def subjects_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sorted_kinds(registry(spark, sf_dir))


@query("J-2", sql=WITH + """, latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY version DESC) AS r FROM registry) WHERE r = 1)
SELECT t.topic, k.version AS key_version, v.version AS value_version, o.version AS other_version, v.schema AS value_schema
FROM (SELECT DISTINCT lower(replace(p_brand, '#', '')) AS topic FROM part UNION ALL SELECT 'brand-none') t
LEFT JOIN latest k ON k.subject = t.topic || '-key' LEFT JOIN latest v ON v.subject = t.topic || '-value'
LEFT JOIN latest o ON o.subject = t.topic""")
def topic_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = table(spark, sf_dir, "part").select(F.expr("lower(replace(p_brand, '#', '')) || '-key' AS topic"))
    topics = brands.unionByName(spark.range(1).select(F.lit("brand-none").alias("topic")))
    found = R.topic_subjects(topics, registry(spark, sf_dir))
    return found.select(
        "topic", F.col("key.version").alias("key_version"), F.col("value.version").alias("value_version"),
        F.col("other.version").alias("other_version"), F.col("value.schema").alias("value_schema"),
    )


@query("J-3", sql=WITH + """
SELECT subject, previous_version, previous_schema, latest_version, latest_schema FROM (
  SELECT subject, version AS latest_version, schema AS latest_schema, lag(version) OVER w AS previous_version, lag(schema) OVER w AS previous_schema,
         row_number() OVER (PARTITION BY subject ORDER BY version DESC) AS r FROM registry WINDOW w AS (PARTITION BY subject ORDER BY version))
WHERE r = 1 AND previous_version IS NOT NULL""")
def schema_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.previous_pairs(registry(spark, sf_dir))


@query("X-12", sql=r"""
SELECT event_id, 'topic-' || event_type AS topic FROM events""")
def stripped_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.element_at(F.array(F.lit("-key"), F.lit("-value"), F.lit("")), (F.col("event_id") % 3 + 1).cast("int"))
    subject = F.concat(F.lit("topic-"), "event_type", suffix)
    return table(spark, sf_dir, "events").select("event_id", X.strip_suffix(subject).alias("topic"))
