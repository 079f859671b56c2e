"""Sources of JSON and text documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sluice import envelope
from sluice.operators import datagen


def messages(lines: DataFrame, text: str = "value") -> DataFrame:
    """Envelopes from JSON lines, with ``error`` set where a line is not a complete envelope."""
    return envelope.read_json(lines, text, "m").select("m.value.*", "m.error")


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    return messages(spark.read.text(path))


def read_documents(spark: SparkSession, path: str, seed: Column) -> DataFrame:
    """Whole files, each an Avro schema or a JSON document."""
    files = spark.read.text(path, wholetext=True)
    return datagen.parse_documents(files, "value", seed)
