"""Queries over keyed documents and materialised tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sluice.operators import keyed
from sluice.plans.catalog import query
from sluice.plans.inputs import CHANGES_SQL, MESSAGES_SQL, change_log, envelopes, table
from sluice.session import shared_dir
from sluice.sinks import tables as sink

WITH = f"WITH {CHANGES_SQL} "
CURRENT_SQL = f"""{CHANGES_SQL}, current_docs AS (
  SELECT path, body, seq FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS r FROM changes) WHERE r = 1 AND op = 'put')"""


@query("T-9", sql=f"WITH {CURRENT_SQL} SELECT path, body, seq FROM current_docs")
def current_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.current(change_log(spark, sf_dir))


@query("T-9", "T-10", sql=WITH + """
SELECT seq, path, op, body, before AS existed, CASE WHEN op = 'put' THEN CASE WHEN before THEN 200 ELSE 201 END ELSE CASE WHEN before THEN 200 ELSE 410 END END AS status
FROM (SELECT *, coalesce(lag(op) OVER (PARTITION BY path ORDER BY seq) = 'put', false) AS before FROM changes)""")
def change_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.outcomes(change_log(spark, sf_dir))


@query("T-9", sql=f"""WITH {CURRENT_SQL}
SELECT c_custkey, path, body, CASE WHEN body IS NULL THEN 410 ELSE 200 END AS status FROM (
  SELECT c_custkey, a.path, d.body FROM (SELECT c_custkey, 'store/' || (c_custkey % 8) || '/top' AS path FROM customer) a LEFT JOIN current_docs d ON a.path = d.path)""")
def document_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "customer").selectExpr("c_custkey", "'store/' || (c_custkey % 8) || '/top' AS path")
    return keyed.lookup(asked, keyed.current(change_log(spark, sf_dir))).select("c_custkey", "path", "body", "status")


@query("T-10", sql=f"""WITH {CURRENT_SQL}
SELECT DISTINCT 'store' AS prefix, 'dir' AS kind, split_part(path, '/', 2) AS name FROM current_docs
UNION ALL SELECT DISTINCT 'store/3', CASE WHEN path LIKE 'store/3/%/%' THEN 'dir' ELSE 'leaf' END,
                 CASE WHEN path LIKE 'store/3/%/%' THEN split_part(path, '/', 3) ELSE path END FROM current_docs WHERE path LIKE 'store/3/%'
UNION ALL SELECT DISTINCT 'store/1/sub1', 'leaf', path FROM current_docs WHERE path LIKE 'store/1/sub1/%'""")
def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = keyed.current(change_log(spark, sf_dir))
    lists = [
        keyed.listing(documents, prefix).select(F.lit(prefix).alias("prefix"), "kind", "name")
        for prefix in ("store", "store/3", "store/1/sub1")
    ]
    return lists[0].unionByName(lists[1]).unionByName(lists[2])


@query("K-5", "A-8", sql=f"""WITH {MESSAGES_SQL}
SELECT topic AS kind, '{{"id":"u' || user_id || '"}}' AS id, event_id AS version, content_json AS record, total FROM messages, (SELECT count(*) AS total FROM events)""")
def materialised_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "materialised")
    written = sink.append(sink.materialised(envelopes(spark, sf_dir)), path)
    return spark.read.parquet(path).withColumn("total", F.lit(written).cast("bigint"))
