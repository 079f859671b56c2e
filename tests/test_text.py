import json

import pytest
from pyspark.sql import functions as F

from sluice.functions import http as H, text as X


def cell(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_string_templates(spark):
    frame = spark.sql("select 'foo' k, parse_json('2') c, cast(null as string) n")
    row = frame.select(
        X.render(""), X.render("some text"), X.render("key:{{ k }} value: {{ variant_get(c, '$', 'int') * 3 }}"),
        X.render("{{k}}"), X.render('a\n{{ k }}"q"{{ c }}{{ n }}'), X.render("open {{ k"),
    ).first()
    assert tuple(row) == ("", "some text", "key:foo value: 6", "foo", 'a\nfoo"q"2null', "open {{ k")


def test_environment_overlay_and_missing(spark):
    env = X.environment({"a": "1", "b": "2"}, {"b": "3"})
    row = spark.range(1).select(X.env(env, "a"), X.env(env, "b"), X.env(env, "c"), X.env(X.environment({}), "a")).first()
    assert tuple(row) == ("1", "3", "", "")


def test_replace_in_json_reaches_keys_and_values(spark):
    text = json.dumps({"root": {"array": [{"replaceme-key": "replaceme-value"}, "replaceme-string"]}, "replaceme-top": "replaceme-top"})
    out = cell(spark, X.replace_in_json(F.col("t"), "replaceme", "ok"), t=text)
    assert json.loads(out) == {"root": {"array": [{"ok-key": "ok-value"}, "ok-string"]}, "ok-top": "ok-top"}


def test_replace_in_json_leaves_numbers_and_escapes_alone(spark):
    out = cell(spark, X.replace_in_json(F.col("t"), "n", "N"), t='{"n1":1.10,"e":"\\n\\u006e","t":true,"x":null}')
    assert out == '{"N1":1.10,"e":"\\nN","t":true,"x":null}'
    assert cell(spark, X.replace_in_json(F.col("t"), "1", '"2"'), t='{"a":1,"b":"1"}') == '{"a":1,"b":"\\"2\\""}'


@pytest.mark.parametrize("value", [
    {"a\\": 'x"a', "\\": ["a\\", "\\\\a", '"', '\\"a'], "n": 1.5, "u": "é\u2028a\n", "": ""}, "a", ["aaa", "aa" * 50], {}, 'a"' * 3000, "b\\" * 3000])
def test_replace_in_json_equals_a_walk_over_the_value(spark, value):
    def walk(v):
        if isinstance(v, str):
            return v.replace("a", '"\\')
        if isinstance(v, list):
            return [walk(x) for x in v]
        return {walk(k): walk(x) for k, x in v.items()} if isinstance(v, dict) else v

    column = X.replace_in_json(F.col("t"), "a", '"\\')
    for text in (json.dumps(value), json.dumps(value, ensure_ascii=False)):
        assert json.loads(cell(spark, column, t=text)) == walk(value)
    assert cell(spark, column, t='{"a": "open') == '{"\\"\\\\": "open'
    plan = spark.createDataFrame([("{}",)], "t string").select(column)._jdf.queryExecution().toString()
    assert "EvalPython" not in plan


def test_index_placeholder(spark):
    assert cell(spark, X.replace_index(F.col("t"), F.lit(12)), t='{"{{i}}":"v-{{i}}","n":1}') == '{"12":"v-12","n":1}'


@pytest.mark.parametrize(
    "text, once, fully",
    [
        ('"a"', "a", "a"), (' "a" ', "a", "a"), ('\\"a\\"', "a", '\\"a\\"'), ('""a""', '"a"', "a"), ("a", "a", "a"),
        ('"', '"', '"'), ('""', "", ""), ('"""', '"', '"'), (' " "x" " ', ' "x" ', "x"), ('"a', '"a', '"a'), ("", "", ""), ("  ", "  ", ""),
    ],
)
def test_unquote(spark, text, once, fully):
    row = spark.createDataFrame([(text,)], "t string").select(X.unquote(F.col("t")), X.unquote_all(F.col("t"))).first()
    assert tuple(row) == (once, fully)


@pytest.mark.parametrize("subject, topic", [("a-key", "a"), ("a-value", "a"), ("a", "a"), ("a-key-value", "a-key"), ("a-keys", "a-keys"), ("-key", "")])
def test_strip_suffix(spark, subject, topic):
    assert cell(spark, X.strip_suffix(F.col("s")), s=subject) == topic


def test_field_names(spark):
    assert cell(spark, X.field_name(F.col("s")), s="a-b é9_x.y") == "a_b_é9_x_y"


def test_coordinates(spark):
    row = spark.range(1).select(
        X.coordinates(F.lit("t"), F.lit(0), F.lit(12), F.lit("k")), X.coordinates(F.lit("t"), F.lit(0), F.lit(12), F.lit(None)),
        X.position(F.lit(0), F.lit(12)),
    ).first()
    assert tuple(row) == ("{t:0/12@k}", "{t:0/12@null}", "0:12")


def test_request_json_round_trip(spark):
    body = F.parse_json(F.lit('[1,{"b":2,"a":1}]'))
    made = spark.range(1).select(H.with_body(H.with_header(H.post(F.lit("http://x")), "a", F.lit("b")), body).alias("r"))
    row = made.select(F.to_json("r").alias("a"), F.to_json(H.from_json(H.to_json(F.col("r")))).alias("b")).first()
    a, b = json.loads(row["a"]), json.loads(row["b"])
    assert a == b and a["headers"] == {"a": "b", "Content-Type": "application/json"}


def test_header_is_replaced(spark):
    req = H.with_header(H.get(F.lit("u"), F.create_map(F.lit("h"), F.lit("old"))), "h", F.lit("new"))
    assert spark.range(1).select(req["headers"]).first()[0] == {"h": "new"}


def test_unknown_method():
    with pytest.raises(ValueError, match="expected one of"):
        H.request("PATCH", None)


LINE = (
    'HTTP/1.1 POST /rest/store/fool.sc Headers(Host: localhost:8080, User-Agent: Browser/1.0 (Test; x), Accept: */*, '
    'Cookie: <REDACTED>) body="{}"'
)
BODY = 'first "quoted" line\nsecond (line)\n\nlast'


@pytest.mark.parametrize(
    "line, kind, route, status, body",
    [
        (LINE.replace("{}", BODY), "POST", "/rest/store/fool.sc", None, BODY),
        ('x HTTP/1.1 GET /rest/a Headers(A: b; C: d) body="', "GET", "/rest/a", None, None),
        ('HTTP/1.1 GET /d/foo Headers() body="', "IGNORED", "/d/foo", None, None),
        ('HTTP/1.1 POST /rest/a Headers(User-Agent: Probe 1) body="x"', "IGNORED", "/rest/a", None, "x"),
        ('HTTP/1.1 404 Not Found Headers(A: b) body="no\nway"', "RESPONSE", None, 404, "no\nway"),
        ("nothing", "UNKNOWN", None, None, None),
    ],
)
def test_access_log_lines(spark, line, kind, route, status, body):
    row = spark.createDataFrame([(line,)], "l string").select(H.parse_log(F.col("l"), ignored_agent="Probe").alias("p")).first()["p"]
    assert (row["kind"], row["route"], row["status"], row["body"]) == (kind, route, status, body)


def test_access_log_headers(spark):
    frame = spark.createDataFrame([('HTTP/1.1 GET /rest/a Headers(A: b; C: d; A: e; junk) body="',)], "l string")
    assert frame.select(H.parse_log(F.col("l"))["headers"]).first()[0] == {"A": "e", "C": "d"}
