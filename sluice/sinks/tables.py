"""Table sinks: materialised messages, and per-epoch tables that a replayed micro-batch overwrites."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from sluice.functions import dynamic as D

NO_TABLE = -1


def materialised(df: DataFrame, kind: Column | None = None, id_: Column | None = None, version: Column | None = None,
                 record: Column | None = None) -> DataFrame:
    """Messages as rows (kind, id, version, record): topic, key, offset and content unless given."""
    return df.select(
        (F.col("topic") if kind is None else kind).alias("kind"),
        (D.as_string(F.col("key")) if id_ is None else id_).alias("id"),
        (F.col("offset") if version is None else version).cast("bigint").alias("version"),
        (F.to_json("content") if record is None else record).alias("record"),
    )


def append(rows: DataFrame, path: str | None, pipeline: str | None = None, epoch: int | None = None) -> int:
    """Append to a Parquet table and return how many rows were written; -1 when no table is configured.

    With the pipeline and epoch of a micro-batch, a replay replaces what it wrote before; ``read_epochs``
    reads such a table.
    """
    if not path:
        return NO_TABLE
    if pipeline is not None and epoch is not None:
        return _counted(rows, lambda df: write_epoch(df, path, pipeline, epoch))
    return _counted(rows, lambda df: df.write.mode("append").parquet(path))


def insert_jdbc(rows: DataFrame, url: str | None, table: str, **options: str) -> int:
    """Append to a database table; -1 when no database is configured."""
    if not url:
        return NO_TABLE
    return _counted(rows, lambda df: df.write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save())


def _counted(rows: DataFrame, write) -> int:
    seen = Observation()
    write(rows.observe(seen, F.count(F.lit(1)).alias("n")))
    return int(seen.get["n"])


def write_epoch(rows: DataFrame, path: str, pipeline: str, epoch: int) -> None:
    """Replace what this pipeline wrote for this epoch; other epochs stay."""
    rows.write.mode("overwrite").parquet(f"{path}/pipeline={pipeline}/epoch={epoch}")


def read_epochs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All epochs of all pipelines, with their ``pipeline`` and ``epoch``; empty before the first one."""
    full = f"{schema}, pipeline string, epoch bigint"
    try:
        return spark.read.schema(full).option("basePath", path).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)
