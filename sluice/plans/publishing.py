"""Queries over publishing templates and HTTP requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sluice.functions import codec, dynamic as D, http as H
from sluice.functions.staging import once
from sluice.operators import publish, stats
from sluice.plans.catalog import query
from sluice.plans.inputs import MESSAGES_SQL, envelopes, table
from sluice.sinks import http as http_sink, topics as topic_sink

# One template per customer; segments decide on tombstones, repeats and overrides.
TEMPLATES = {
    "data": """CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'null' ELSE '{"data":"value-{{i}}","id":' || c_custkey || '}' END""",
    "config": "'consumer.groupId=g{{i}}'",
    "key": """CASE WHEN c_custkey % 2 = 0 THEN '"record-{{i}}"' ELSE '{"id":"{{i}}"}' END""",
    "repeat": "cast(c_custkey % 4 as int)",
    "partition": "CASE WHEN c_custkey % 3 = 0 THEN cast(c_custkey % 2 as int) END",
    "topic_override": "CASE WHEN c_custkey % 7 = 0 THEN 'topic-{{i}}' END",
}


def _templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [F.expr(text).alias(name) for name, text in TEMPLATES.items()]
    headers = F.create_map(F.lit("h{{i}}"), F.lit("v{{i}}"), F.lit("name"), F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", *columns, headers.alias("headers"))


TEMPLATES_SQL = "templates AS (SELECT c_custkey, c_name, " + ", ".join(f"{t} AS {n}" for n, t in TEMPLATES.items()) + " FROM customer)"
REPEATED_SQL = TEMPLATES_SQL + ", repeated AS (SELECT *, unnest(range(greatest(repeat, 1))) AS i FROM templates)"


@query("G-5", "X-7", "X-6", sql=f"""WITH {REPEATED_SQL}
SELECT c_custkey, i AS "index", replace(config, '{{{{i}}}}', i || '') AS config, replace(data, '{{{{i}}}}', i || '') AS data,
       replace("key", '{{{{i}}}}', i || '') AS "key", replace(topic_override, '{{{{i}}}}', i || '') AS topic_override, 'v' || i AS header
FROM repeated""")
def repeated_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = publish.fill(publish.repeat(_templates(spark, sf_dir)))
    header = F.try_element_at("headers", F.concat(F.lit("h"), F.col("index").cast("string")))
    return filled.select("c_custkey", "index", "config", "data", "key", "topic_override", header.alias("header"))


@query("G-6", "F-2", "K-1", "K-2", "K-3", sql=f"""WITH {REPEATED_SQL}
SELECT coalesce(replace(topic_override, '{{{{i}}}}', i || ''), 'any-topic') AS topic,
       CASE WHEN c_custkey % 2 = 0 THEN 'record-' || i ELSE '{{"id":"' || i || '"}}' END AS "key",
       CASE WHEN c_custkey % 5 > 1 THEN '{{"data":"value-' || i || '","id":' || c_custkey || '}}' END AS value, "partition",
       'h' || i || '=v' || i || ',name=' || c_name AS headers
FROM repeated""")
def published_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = publish.records(_templates(spark, sf_dir), "*-topic")
    pairs = F.transform("headers", lambda h: F.concat(h["key"], F.lit("="), codec.utf8(h["value"])))
    return records.select(
        "topic", codec.utf8(F.col("key")).alias("key"), codec.utf8(F.col("value")).alias("value"), "partition",
        F.array_join(F.array_sort(pairs), ",").alias("headers"),
    )


@query("K-1", "K-2", sql=f"""WITH {MESSAGES_SQL}
SELECT 'out-' || topic AS topic, 'u' || user_id AS "key", CAST(content_json->>'$.props.k' AS BIGINT) AS value, partition_id AS "partition" FROM messages""")
def record_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = envelopes(spark, sf_dir)
    made = topic_sink.record(
        e, F.concat(F.lit("out-"), "topic"), D.field(F.col("key"), "id"), D.field(F.col("content"), "props", "k"),
        value_type="long", headers=F.col("headers"), partition=F.col("partition"),
    )
    return made.select(
        "topic", codec.utf8(F.col("key")).alias("key"), codec.long_from_bytes(F.col("value")).alias("value"), "partition"
    )


URL = "http://localhost:8080/rest/store"


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero to two POST requests per message, each with the enriched message as its body."""
    e = envelopes(spark, sf_dir, dealt=True)
    k = D.as_int(D.select(F.col("content"), "props", "k"))

    def build(v, i):
        url = F.concat(F.lit(URL), F.lit("/"), "topic", F.lit("/"), F.col("offset").cast("string"), F.lit("/"), i.cast("string"))
        body = D.merge_levels(v, F.to_variant_object(F.struct(i.alias("n"))), 1)
        return H.with_header(H.with_body(H.post(url), body), "X-Topic", F.col("topic"))

    counted = once(e, content=F.col("content")).withColumn("n_requests", k % 3)
    return once(counted, requests=H.requests_for(F.col("content"), F.col("n_requests"), build))


REQUESTS_SQL = MESSAGES_SQL + f""",
counted AS (SELECT *, CAST(content_json->>'$.props.k' AS INTEGER) % 3 AS n_requests FROM messages),
requests AS (
  SELECT topic, event_id, n_requests, i, '{URL}/' || topic || '/' || event_id || '/' || i AS url,
         '{{"event_id":' || event_id || ',"n":' || i || ',"props":' || (content_json->'$.props') || ',"type":"' || event_type
           || '","value_cents":' || (content_json->>'$.value_cents') || '}}' AS body
  FROM (SELECT *, unnest(range(n_requests)) AS i FROM counted))"""


@query("P-13", "X-14", sql=f"""WITH {REQUESTS_SQL}
SELECT event_id, 'POST' AS method, url, body, 'application/json' AS content_type, topic FROM requests""")
def message_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _requests(spark, sf_dir).select("event_id", F.explode("requests").alias("r"))
    return r.select(
        "event_id", "r.method", "r.url", codec.utf8(F.col("r.body")).alias("body"),
        F.try_element_at("r.headers", F.lit("Content-Type")).alias("content_type"),
        F.try_element_at("r.headers", F.lit("X-Topic")).alias("topic"),
    )


@query("X-15", sql=f"""
SELECT page_id, '{{"body":' || CASE WHEN page_id % 2 = 0 THEN '{{"page":' || page_id || '}}' ELSE '"' || to_base64(encode(url)) || '"' END
       || ',"headers":{{"A":"b"}},"method":"PUT","url":"{URL}/' || page_id || '"}}' AS json,
       CASE WHEN page_id % 2 = 0 THEN '{{"page":' || page_id || '}}' ELSE '"' || to_base64(encode(url)) || '"' END AS body, true AS unknown_method
FROM pages""")
def request_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("page_id").cast("string")
    body = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('{"page":'), key, F.lit("}"))).otherwise(F.col("url"))
    req = H.request("PUT", F.concat(F.lit(URL + "/"), key), F.create_map(F.lit("A"), F.lit("b")), F.encode(body, "UTF-8"))
    made = table(spark, sf_dir, "pages").select("page_id", H.to_json(req).alias("v"))
    back = made.select("page_id", "v", H.from_json(F.col("v")).alias("r"))
    odd = D.merge_levels(F.col("v"), F.parse_json(F.lit('{"method":"PATCH"}')), 1)
    return back.select(
        "page_id", F.to_json("v").alias("json"), codec.utf8(F.col("r.body")).alias("body"),
        H.from_json(odd).isNull().alias("unknown_method"),
    )


@query("X-14", sql="""
SELECT event_id, method, '/' || user_id AS url, CASE WHEN method = 'GET' THEN 2 ELSE 1 END AS headers,
       CASE WHEN method = 'GET' THEN 'new' ELSE 'old' END AS h, 0 AS body_bytes
FROM events, (VALUES ('GET'), ('PUT'), ('DELETE')) AS m(method)""")
def request_builders(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("/"), F.col("user_id").cast("string"))
    headers = F.create_map(F.lit("h"), F.lit("old"))
    get = H.with_header(H.with_header(H.get(url, headers), "h", F.lit("new")), "g", F.lit("x"))
    all_ = F.array(get, H.put(url, headers), H.delete(url, headers))
    made = table(spark, sf_dir, "events").select("event_id", F.explode(all_).alias("r"))
    return made.select(
        "event_id", "r.method", "r.url", F.size("r.headers").alias("headers"),
        F.try_element_at("r.headers", F.lit("h")).alias("h"), F.length("r.body").alias("body_bytes"),
    )


def _answer(method: str, url: str, headers: dict, body: bytes) -> tuple[int, str]:
    """In-process transport: the offset in the URL decides the status; some calls fail."""
    offset = int(url.rsplit("/", 2)[1])
    if offset % 11 == 0:
        raise ConnectionError("refused")
    return (500 if offset % 5 == 0 else 200), f"{method} {len(body)}"


@query("K-4", "T-8", sql=f"""WITH {REQUESTS_SQL}
SELECT event_id, url, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 500 ELSE 200 END AS status,
       CASE WHEN event_id % 11 <> 0 THEN 'POST ' || length(body) END AS reply,
       CASE WHEN event_id % 11 = 0 THEN 'ConnectionError: refused' END AS error, CASE WHEN event_id % 11 = 0 THEN 2 ELSE 1 END AS attempts
FROM requests""")
def http_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = http_sink.post_all(_requests(spark, sf_dir).select("event_id", "requests"), "requests", _answer, attempts=2, backoff=0.0)
    r = sent.select("event_id", F.explode("results").alias("r"))
    return r.select(
        "event_id", "r.request.url", F.col("r.response.statusCode").alias("status"), F.col("r.response.body").alias("reply"),
        "r.error", "r.attempts",
    )


def _with_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with the results of their requests, as the sink gives them: answers, refusals and calls that raise."""
    return http_sink.post_all(_requests(spark, sf_dir).select("event_id", "requests"), "requests", _answer)


ANSWERED_SQL = f"""WITH {REQUESTS_SQL}, answered AS (
  SELECT event_id, i, event_id % 11 = 0 OR event_id % 5 = 0 AS failed,
         CASE WHEN event_id % 11 = 0 THEN 'Error: ConnectionError: refused' ELSE url || ' yields ' || CASE WHEN event_id % 5 = 0 THEN 500 ELSE 200 END END AS line,
         CASE WHEN event_id % 11 = 0 THEN '{{"error":"ConnectionError: refused"}}' ELSE
         '{{"request":{{"body":' || body || ',"headers":{{"Content-Type":"application/json","X-Topic":"' || topic || '"}},"method":"POST","url":"' || url
         || '"}},"response":{{"body":"POST ' || length(body) || '","code":' || CASE WHEN event_id % 5 = 0 THEN 500 ELSE 200 END || '}}}}' END AS json FROM requests)"""


@query("A-4", "K-4", sql=f"""{ANSWERED_SQL}
SELECT c.event_id, CASE c.n_requests WHEN 1 THEN a.lines ELSE c.n_requests || E' requests: [\n' || coalesce(a.lines, '') || E'\n]' END AS message,
       CASE c.n_requests WHEN 1 THEN a.jsons ELSE '[' || coalesce(a.jsons, '') || ']' END AS json
FROM counted c LEFT JOIN (
  SELECT event_id, string_agg(line, E'\n' ORDER BY i) AS lines, string_agg(json, ',' ORDER BY i) AS jsons
  FROM answered GROUP BY event_id) a ON c.event_id = a.event_id""")
def http_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _with_results(spark, sf_dir)
    return r.select(
        "event_id", stats.results_text(F.col("results")).alias("message"), F.to_json(stats.results_json(F.col("results"))).alias("json")
    )


@query("F-3", "K-4", sql=f"""{ANSWERED_SQL}
SELECT event_id, count(*) AS failed, 'Not all rest results returned successfully: ' ||
       CASE count(*) WHEN 1 THEN any_value(line) ELSE count(*) || E' requests: [\n' || string_agg(line, E'\n' ORDER BY i) || E'\n]' END AS error
FROM answered WHERE failed GROUP BY event_id""")
def http_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = stats.rest_failures(_with_results(spark, sf_dir))
    return failed.select("event_id", F.size("results").cast("bigint").alias("failed"), "error")


@query("X-17", sql="""
SELECT page_id, kind, route, status, body, host FROM (
  SELECT page_id, 'POST' AS kind, '/rest/p' || page_id AS route, CAST(NULL AS INTEGER) AS status, html AS body, 'h' || page_id AS host FROM pages WHERE page_id % 4 = 0
  UNION ALL SELECT page_id, 'GET', '/rest/p' || page_id, NULL, NULL, 'h' || page_id FROM pages WHERE page_id % 4 = 1
  UNION ALL SELECT page_id, 'IGNORED', '/d/p' || page_id, NULL, NULL, 'h' || page_id FROM pages WHERE page_id % 4 = 2
  UNION ALL SELECT page_id, 'RESPONSE', NULL, 200, html, 'h' || page_id FROM pages WHERE page_id % 4 = 3)""")
def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("page_id").cast("string")
    headers = F.concat(F.lit("Headers(Host: h"), key, F.lit(', Accept: */*) body="'))

    def line(start: str, path: str, tail) -> F.Column:
        return F.concat(F.lit(start), F.lit(path), key if path else F.lit(""), F.lit(" "), headers, tail)

    body = F.concat(F.col("html"), F.lit('"'))
    text = (
        F.when(F.col("page_id") % 4 == 0, line("HTTP/1.1 POST ", "/rest/p", body))
        .when(F.col("page_id") % 4 == 1, line("HTTP/1.1 GET ", "/rest/p", F.lit("")))
        .when(F.col("page_id") % 4 == 2, line("HTTP/1.1 GET ", "/d/p", F.lit("")))
        .otherwise(line("HTTP/1.1 200 OK", "", body))
    )
    lines = table(spark, sf_dir, "pages").select("page_id", text.alias("line"))
    parsed = lines.select("page_id", H.parse_log(F.col("line"), ", ").alias("p"))
    return parsed.select(
        "page_id", "p.kind", "p.route", "p.status", "p.body", F.try_element_at("p.headers", F.lit("Host")).alias("host")
    )
