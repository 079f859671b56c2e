"""Topic sinks: Kafka where the connector is present, files with the same record layout anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sluice.functions import codec
from sluice.operators.publish import header_records, _as_bytes
from sluice.sources.topics import KafkaUnavailable, _kafka

__all__ = ["KafkaUnavailable", "record", "publish", "publish_files"]


def record(df: DataFrame, topic: Column, key: Column, value: Column, *, key_type: str = "string", value_type: str = "json",
           headers: Column | None = None, partition: Column | None = None) -> DataFrame:
    """One record per row: ``key`` and ``value`` are JSON values, a NULL value is a tombstone."""
    no_headers = F.create_map().cast("map<string,string>")
    return df.select(
        topic.alias("topic"),
        _as_bytes(codec.serialise(key, key_type), key_type).alias("key"),
        F.when(value.isNotNull(), _as_bytes(codec.serialise(value, value_type), value_type)).alias("value"),
        header_records(no_headers if headers is None else headers).alias("headers"),
        (F.lit(None).cast("int") if partition is None else partition.cast("int")).alias("partition"),
    )


def publish(records: DataFrame, bootstrap_servers: str, **options: str) -> None:
    """Write records to their topics; the producer's delivery timeout bounds each send."""
    settings = {"kafka.delivery.timeout.ms": "60000", "kafka.request.timeout.ms": "30000", **options}
    writer = records.write.format("kafka").option("kafka.bootstrap.servers", bootstrap_servers).options(**settings)
    _kafka(writer.save)


def publish_files(records: DataFrame, path: str, mode: str = "append") -> None:
    """Write records as Parquet, partitioned by topic."""
    records.withColumn("_topic", F.col("topic")).write.partitionBy("_topic").mode(mode).parquet(path)
