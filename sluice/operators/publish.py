"""Publishing templates: repeats, placeholders, target topics and the record layout of the sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sluice.envelope import tombstone
from sluice.functions import codec, text as X

HEADERS = T.MapType(T.StringType(), T.StringType())

# One publishing template; ``data`` and ``key`` are JSON texts.
TEMPLATE = T.StructType(
    [
        T.StructField("data", T.StringType()),
        T.StructField("config", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("repeat", T.IntegerType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("topic_override", T.StringType()),
        T.StructField("headers", HEADERS),
    ]
)

_STRIDE = 1 << 16


def repeat(df: DataFrame, times: str = "repeat", index: str = "index", spread: bool = True) -> DataFrame:
    """Each row ``max(times, 1)`` times with indices from 0.

    Indices are laid out in strides, so one row with a large count needs no large array, and the strides
    are dealt out over all tasks; ``spread=False`` leaves them where their row is.
    """
    top = F.greatest(F.coalesce(F.col(times), F.lit(0)), F.lit(1)).cast("bigint") - 1
    strides = df.withColumn("_top", top)
    strides = strides.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_top"), F.lit(_STRIDE).cast("bigint"))))
    if spread:
        strides = strides.repartition(F.xxhash64("_from", times))
    last = F.least(F.col("_from") + (_STRIDE - 1), F.col("_top"))
    return strides.withColumn(index, F.explode(F.sequence(F.col("_from"), last))).drop("_top", "_from")


def fill(df: DataFrame, index: str = "index") -> DataFrame:
    """Put the index into the placeholders of config, data, key, topic override and headers."""
    i = F.col(index)

    def put(c: Column) -> Column:
        return X.replace_index(c, i)

    # keys that become equal keep the last value
    entries = F.transform(F.map_entries("headers"), lambda e: F.struct(put(e["key"]).alias("key"), put(e["value"]).alias("value")))
    keys = F.transform(entries, lambda e: e["key"])
    last = F.filter(entries, lambda e, n: ~F.array_contains(F.slice(keys, n + 2, F.size(keys)), e["key"]))
    columns = {c: put(F.col(c)) for c in ("config", "data", "key", "topic_override")}
    return df.withColumns({**columns, "headers": F.map_from_entries(last)})


def target_topic(override: Column, configured: Column) -> Column:
    """The override, else the configured topic with ``*`` spelled ``any``."""
    return F.coalesce(override, F.replace(configured, F.lit("*"), F.lit("any")))


def header_records(headers: Column) -> Column:
    """Headers as the sink takes them: ARRAY<STRUCT<key, value BINARY>>."""
    entries = F.transform(
        F.map_entries(headers), lambda e: F.struct(e["key"].alias("key"), F.encode(e["value"], "UTF-8").alias("value"))
    )
    return F.coalesce(entries, F.array().cast("array<struct<key:string,value:binary>>"))


def value_or_tombstone(data: Column, value: Column) -> Column:
    return F.when(~tombstone(data), value)


def _as_bytes(column: Column, wire: str) -> Column:
    wire = codec.wire_type(wire)
    if wire == "long":
        return codec.long_to_bytes(column)
    return column if wire == "bytes" or wire.startswith("avro") else F.encode(column, "UTF-8")


def records(templates: DataFrame, topic: str, key_type: str = "string", value_type: str = "json",
            spread: bool = False) -> DataFrame:
    """Templates as records ready for a topic sink: topic, key, value, headers, partition.

    An unset partition is NULL; 0 is a partition like any other.
    """
    filled = fill(repeat(templates, spread=spread))
    data = F.coalesce(codec.parse_text(F.col("data")), F.col("data").cast(T.VariantType()))
    key = codec.text_to_json(F.col("key"))
    value = F.when(~tombstone(data), codec.serialise(data, value_type))
    return filled.select(
        target_topic(F.col("topic_override"), F.lit(topic)).alias("topic"),
        _as_bytes(codec.serialise(key, key_type), key_type).alias("key"),
        _as_bytes(value, value_type).alias("value"),
        header_records(F.col("headers")).alias("headers"),
        F.col("partition"),
    )
