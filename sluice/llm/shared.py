"""What several of these operators need: staged tables in the shared folder, row numbers, text helpers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sluice.session import shared_dir

# ASCII white space, U+0009 to U+000D and U+0020
BLANKS = " \t\n\x0b\f\r"


_recorded: ContextVar[list[str] | None] = ContextVar("recorded", default=None)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The folders of the tables that are staged in the meantime."""
    folders: list[str] = []
    token = _recorded.set(folders)
    try:
        yield folders
    finally:
        _recorded.reset(token)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the folder all executors share and read it back, so that nothing recomputes it."""
    path = shared_dir(df.sparkSession, label)
    if (folders := _recorded.get()) is not None:
        folders.append(path)
    df.write.option("compression", "zstd").parquet(path)
    # nothing reads the shuffle files of this job again; Spark deletes them once the driver has collected its garbage
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discarded(table: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    for folder in _folders(table):
        _delete(table.sparkSession, folder)


def _folders(table: DataFrame) -> set[str]:
    return {name.rsplit("/", 1)[0] for name in table.inputFiles()}


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def leftovers_discarded(spark: SparkSession, folders: list[str], docs: DataFrame) -> list[str]:
    """Delete staged tables by folder, but for those that ``docs`` still reads; returns these."""
    read = {folder.rsplit("/", 1)[1] for folder in _folders(docs)}
    kept = [folder for folder in folders if folder.rsplit("/", 1)[1] in read]
    for folder in folders:
        if folder not in kept:
            _delete(spark, folder)
    return kept


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def numbered(df: DataFrame, label: str, name: str = "_rid") -> DataFrame:
    """Give every row a number and write the table, so that the numbers hold however often it is read."""
    return staged(df.withColumn(name, F.monotonically_increasing_id()), label)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def without_blanks(text: Column) -> Column:
    return F.translate(text, BLANKS, "")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
