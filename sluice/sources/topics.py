"""Topic sources: Kafka where the connector is present, files with the same record layout anywhere."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from sluice import envelope
from sluice.functions.codec import wire_type
from sluice.operators.batching import MAX_COUNT, MAX_MILLIS
from sluice.operators.routing import subscription


RANDOM = "<random>"


class KafkaUnavailable(RuntimeError):
    """Raised when the Kafka connector is not on the session's classpath."""


def starting_offsets(offset: str) -> str:
    """``earliest`` or ``latest``; anything else is an error."""
    if offset not in ("earliest", "latest"):
        raise ValueError(f"bad offset: only earliest and latest are supported, not {offset}")
    return offset


@dataclass
class TopicConfig:
    """Where to read records and how to decode them."""

    topic: str
    bootstrap_servers: str = ""
    offset: str = "earliest"
    key_type: str = "string"
    value_type: str = "json"
    key_schema: str | None = None
    value_schema: str | None = None
    max_count: int = MAX_COUNT
    max_millis: int = MAX_MILLIS
    options: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.topic == RANDOM:
            # a new topic of its own
            self.topic = f"topic{uuid.uuid4().hex}"
        starting_offsets(self.offset)
        wire_type(self.key_type)
        wire_type(self.value_type)

    def kafka_options(self) -> dict[str, str]:
        name, value = subscription(self.topic)
        return {
            "kafka.bootstrap.servers": self.bootstrap_servers,
            name: value,
            "startingOffsets": self.offset,
            # a micro-batch starts at so many records or after so long, and takes all there are
            "minOffsetsPerTrigger": str(self.max_count),
            "maxTriggerDelay": f"{self.max_millis}ms",
            "includeHeaders": "true",
            **self.options,
        }

    def trigger(self) -> dict[str, str]:
        # the source holds a batch back until it is full or old enough
        return {"processingTime": "0 milliseconds"}


def _kafka(build):
    try:
        return build()
    except Exception as error:
        if "data source: kafka" in str(error) or "DATA_SOURCE_NOT_FOUND" in str(error):
            raise KafkaUnavailable(
                "reading topics needs the Kafka connector: start Spark with --packages org.apache.spark:spark-sql-kafka-0-10"
            ) from error
        raise


def kafka_stream(spark: SparkSession, config: TopicConfig) -> DataFrame:
    """Records of the subscribed topics as a stream, in the record layout."""
    return _kafka(lambda: spark.readStream.format("kafka").options(**config.kafka_options()).load())


def kafka_table(spark: SparkSession, config: TopicConfig) -> DataFrame:
    """The same subscription read once, as a batch."""
    options = {k: v for k, v in config.kafka_options().items() if k != "maxOffsetsPerTrigger"}
    options["startingOffsets"] = "earliest"
    return _kafka(lambda: spark.read.format("kafka").options(**options).load())


def file_stream(spark: SparkSession, path: str, max_files: int = 100, glob: str | None = None, schema=envelope.RECORD) -> DataFrame:
    """Parquet files in the record layout as a stream."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", str(max_files))
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def envelopes(records: DataFrame, config: TopicConfig) -> DataFrame:
    """Decoded envelopes of a record stream or table."""
    return envelope.from_records(
        records, config.key_type, config.value_type, key_schema=config.key_schema, value_schema=config.value_schema
    )
