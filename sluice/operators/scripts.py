"""User transformations: Spark SQL text per message, Python callables per batch, and trial runs of both."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sluice import envelope
from sluice.functions import codec, dynamic as D, text as X
from sluice.functions.staging import once

# Accessors for scripts, as SQL functions that the optimizer inlines. Paths are written ``content:a.b[0]``.
SQL_FUNCTIONS = {
    "as_text": ("v VARIANT", "STRING", "coalesce(CAST(v AS STRING), 'null')"),
    "as_long": (
        "v VARIANT, otherwise BIGINT",
        "BIGINT",
        "coalesce(CASE WHEN schema_of_variant(v) = 'BIGINT' "
        "OR (schema_of_variant(v) LIKE 'DECIMAL%' AND NOT contains(to_json(v), '.')) "
        "THEN try_variant_get(v, '$', 'bigint') "
        "WHEN schema_of_variant(v) = 'DOUBLE' AND try_variant_get(v, '$', 'double') = floor(try_variant_get(v, '$', 'double')) "
        "THEN try_cast(try_variant_get(v, '$', 'double') AS BIGINT) END, otherwise)",
    ),
    "as_number": (
        "v VARIANT, otherwise DOUBLE",
        "DOUBLE",
        "coalesce(CASE WHEN schema_of_variant(v) IN ('BIGINT', 'DOUBLE', 'FLOAT') OR schema_of_variant(v) LIKE 'DECIMAL%' "
        "THEN try_variant_get(v, '$', 'double') END, otherwise)",
    ),
    "as_flag": (
        "v VARIANT, otherwise BOOLEAN",
        "BOOLEAN",
        "coalesce(CASE WHEN schema_of_variant(v) = 'BOOLEAN' THEN try_variant_get(v, '$', 'boolean') END, otherwise)",
    ),
    "each": ("v VARIANT", "ARRAY<VARIANT>", "coalesce(try_cast(v AS ARRAY<VARIANT>), CAST(array() AS ARRAY<VARIANT>))"),
}


def register_functions(spark: SparkSession) -> None:
    """Make the accessors available to script texts in this session."""
    for name, (arguments, result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")


def _text(script: str) -> str:
    if not script or not script.strip():
        raise ValueError("the script is empty")
    return script


def map_messages(df: DataFrame, script: str, name: str = "result") -> DataFrame:
    """Evaluate one expression per message and add its value."""
    return df.withColumn(name, F.expr(_text(script)))


def flat_map_messages(df: DataFrame, script: str, name: str = "result") -> DataFrame:
    """One row per element of the script's array."""
    return df.withColumn("_items", F.expr(_text(script))).withColumn(name, F.explode("_items")).drop("_items")


def filter_messages(df: DataFrame, rule: str) -> DataFrame:
    """Keep the messages for which the rule holds; dynamic columns the rule names are computed once."""
    dynamic = [f.name for f in df.schema if isinstance(f.dataType, T.VariantType)]
    rule = _text(rule)
    named = [n for n in dynamic if re.search(rf"\b{re.escape(n)}\b", rule)]
    held = once(df, **{n: F.col(n) for n in named}) if named else df
    return held.where(F.expr(rule))


@dataclass
class Console:
    """Lines a handler writes; newest first when read."""

    pipeline: str = ""
    lines: list[tuple[str, str]] = field(default_factory=list)

    def out(self, line: str) -> None:
        self.lines.append(("stdout", line))

    def err(self, line: str) -> None:
        self.lines.append(("stderr", line))

    def frame(self, spark: SparkSession) -> DataFrame:
        numbered = [(self.pipeline, s, n, t) for n, (s, t) in enumerate(self.lines)]
        return spark.createDataFrame(numbered, "pipeline string, stream string, seq int, line string").orderBy(F.desc("seq"))


@dataclass
class Context:
    """What a batch handler gets besides its messages: parameters, tables to write to, a console."""

    env: dict[str, str] = field(default_factory=dict)
    resources: dict[str, Any] = field(default_factory=dict)
    console: Console = field(default_factory=Console)
    keep: Callable[[DataFrame], DataFrame] | None = None

    def kept(self, sent: DataFrame) -> DataFrame:
        """Messages with the results of their requests, after a pipeline has written these for the epoch.

        Requests are sent while results are computed, so look at what this returns: it is read back, and nothing is sent twice.
        """
        return sent if self.keep is None else self.keep(sent)


Handler = Callable[[DataFrame, Context], DataFrame | None]


def log_lines(df: DataFrame, line, stream: str = "stdout") -> DataFrame:
    """Per-message output of a handler as rows: stream, topic, offset, partition, line."""
    return df.select(F.lit(stream).alias("stream"), "topic", "offset", "partition", line.alias("line"))


def messages_from_json(spark: SparkSession, texts: list[str]) -> DataFrame:
    """Envelopes from the JSON texts of a trial request; a text may be one message or an array of them."""
    parsed = spark.createDataFrame([(t,) for t in texts], "text string").select(codec.parse_text(F.col("text")).alias("v"))
    one = parsed.select(F.explode(D.as_vector(F.col("v"))).alias("v"))
    decoded = D.decode_as(one, F.col("v"), envelope.REQUIRED, "m")
    failed = F.raise_error(F.col("m.error")).cast(envelope.SCHEMA)
    return decoded.select(F.when(F.col("m.error").isNull(), F.col("m.value")).otherwise(failed).alias("m")).select("m.*")


def try_script(spark: SparkSession, script: str, content: str, key: str = '""', **fields: Any) -> DataFrame:
    """Run an expression on one message: a row (result JSON, success, messages). Errors come back as data."""
    defaults = {"timestamp": 0, "headers": {}, "topic": "", "offset": 0, "partition": 0}
    message = {"content": json.loads(content), "key": json.loads(key), **defaults, **fields}
    register_functions(spark)
    try:
        one = messages_from_json(spark, [json.dumps(message)]).select(F.struct("*").alias("record"))
        value = map_messages(one, script).select("result")
        result = value.select(F.to_json(codec.to_json_value(F.col("result"), value.schema["result"].dataType)))
        row = (result.first()[0], True, [])
    except Exception as error:
        row = (None, False, [f"Couldn't run '{script}': {error}"])
    return spark.createDataFrame([row], "result string, success boolean, messages array<string>")


def try_config(spark: SparkSession, config: dict[str, str], content: str, key: str = '""',
               env: dict[str, str] | None = None, **fields: Any) -> DataFrame:
    """Evaluate the templates of a configuration on one message: a row (result map, success, messages)."""
    defaults = {"timestamp": 0, "headers": {}, "topic": "", "offset": 0, "partition": 0}
    message = {"content": json.loads(content), "key": json.loads(key), **defaults, **fields}
    register_functions(spark)
    schema = "result map<string,string>, success boolean, messages array<string>"
    try:
        one = messages_from_json(spark, [json.dumps(message)]).select(F.struct("*").alias("record"))
        one = one.withColumn("env", X.environment(env or {}))
        row = (one.select(X.render_config(config)).first()[0], True, [])
    except Exception as error:
        row = (None, False, [f"didn't work w/ input: {error}"])
    return spark.createDataFrame([row], schema)


def try_handler(spark: SparkSession, handler: Handler, messages: list[str], context: Context | None = None) -> DataFrame:
    """Run a batch handler on test messages, topic by topic: a row (stdout, stderr, success, messages).

    A handler's returned rows are run; if they have ``stream`` and ``line`` they are its output.
    """
    context = context or Context()
    out, err, success, notes = [], [], True, ["Success!"]
    try:
        batch = messages_from_json(spark, messages)
        for (topic,) in batch.select("topic").distinct().orderBy("topic").toLocalIterator():
            produced = handler(batch.where(F.col("topic") == topic), context)
            if produced is None:
                continue
            if {"stream", "line"} <= set(produced.columns):
                for row in produced.select("stream", "line").toLocalIterator():
                    (out if row["stream"] == "stdout" else err).append(row["line"])
            else:
                produced.write.format("noop").mode("overwrite").save()
    except Exception as error:
        success, notes = False, ["The handler threw an exception:", str(error)]
    out += [line for stream, line in context.console.lines if stream == "stdout"]
    err += [line for stream, line in context.console.lines if stream == "stderr"]
    schema = "stdout array<string>, stderr array<string>, success boolean, messages array<string>"
    return spark.createDataFrame([(out[::-1], err[::-1], success, notes)], schema)
