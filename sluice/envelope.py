"""The message envelope: one row per record, with dynamic key and content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sluice.functions import codec, dynamic as D

HEADERS = T.MapType(T.StringType(), T.StringType())

SCHEMA = T.StructType(
    [
        T.StructField("content", T.VariantType()),
        T.StructField("key", T.VariantType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("headers", HEADERS),
        T.StructField("topic", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("partition", T.IntegerType()),
    ]
)

# All seven fields are required when an envelope is read from JSON.
REQUIRED = T.StructType([T.StructField(f.name, f.dataType, False) for f in SCHEMA.fields])

# The record layout of Spark's Kafka source and sink.
RECORD = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("timestampType", T.IntegerType()),
        T.StructField(
            "headers",
            T.ArrayType(
                T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.BinaryType())])
            ),
        ),
    ]
)


def from_records(records: DataFrame, key_type: str = "string", value_type: str = "json", *,
                 key_schema: str | None = None, value_schema: str | None = None) -> DataFrame:
    """Records in the Kafka layout as envelopes; undecodable keys and values become error objects."""
    where = {n: F.col(n) for n in ("topic", "partition", "offset")}
    key_text = codec.utf8(F.col("key"))
    headers = codec.header_map(F.col("headers")) if "headers" in records.columns else F.create_map().cast(HEADERS)
    return records.select(
        codec.record_to_json(F.col("value"), value_type, key=key_text, avro_schema=value_schema, **where).alias("content"),
        codec.record_to_json(F.col("key"), key_type, key=key_text, avro_schema=key_schema, **where).alias("key"),
        F.unix_millis(F.col("timestamp")).alias("timestamp"),
        F.coalesce(headers, F.create_map().cast(HEADERS)).alias("headers"),
        "topic",
        "offset",
        "partition",
    )


def to_json(df: DataFrame) -> Column:
    """The envelope as compact JSON text with exactly the seven fields."""
    return F.to_json(F.struct(*[F.col(f.name) for f in SCHEMA.fields]), {"ignoreNullFields": "false"})


def read_json(lines: DataFrame, text: str, name: str = "message") -> DataFrame:
    """Add STRUCT(value: envelope, error): a missing or mistyped field is an error."""
    return D.decode_as(lines, codec.parse_text(F.col(text)), REQUIRED, name)


def rekey(df: DataFrame, key: Column, content: Column) -> DataFrame:
    """New key and content; topic, partition, offset, timestamp and headers stay."""
    return df.withColumns({"key": key, "content": content})


def tombstone(content: Column) -> Column:
    """True for a record that deletes its key: no data, JSON null, or a blank string."""
    blank = F.coalesce(
        (D.kind(content) == "STRING") & F.try_variant_get(content, "$", "string").rlike(r"\A[\x00-\x20]*\z"), F.lit(False)
    )
    return D.is_null(content) | blank
