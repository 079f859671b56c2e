"""SQL query sources: lower-case column names and a ``$row`` number."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from sluice.operators.ranking import BUCKET_WIDTH, range_of, with_position

ROW_NUMBER = "$row"
# Ranges that rows are sorted in, and how many sampled values there are for each.
RANGES, PER_RANGE = 256, 32


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def jdbc_options(url: str, query: str, split: tuple[str, int, int, int] | None = None, **options: str) -> dict[str, str]:
    """Reader options; ``split`` has a numeric column, its bounds and the number of tasks.

    The bounds only place the cuts: rows beyond them go to the first and last task.
    """
    if split is None:
        return {"url": url, "query": query, **options}
    column, low, high, tasks = split
    parts = {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(tasks)}
    return {"url": url, "dbtable": f"({query}) q", **parts, **options}


def jdbc_query(spark: SparkSession, url: str, query: str, *, split: tuple[str, int, int, int] | None = None,
               row_order: str | None = None, **options: str) -> DataFrame:
    """A query that the database runs; needs its driver on the classpath.

    One task reads it all unless ``split`` says how to part it. ``row_order``, a unique integral column,
    adds ``$row``.
    """
    rows = lower_names(spark.read.format("jdbc").options(**jdbc_options(url, query, split, **options)).load())
    return with_row_numbers(rows, row_order) if row_order else rows


def sql_query(spark: SparkSession, query: str) -> DataFrame:
    return lower_names(spark.sql(query))


def with_row_numbers(df: DataFrame, order: str, width: int = BUCKET_WIDTH) -> DataFrame:
    """``$row`` from 1, in the order of one unique integral column."""
    placed = with_position(lower_names(df), [], order.lower(), "_position", width)
    return placed.withColumn(ROW_NUMBER, F.col("_position") + 1).drop("_position")


def _ordering(df: DataFrame, item: str | Column) -> tuple[str, bool, bool]:
    """Column name, descending, nulls first of a sort column: a name, or ``F.asc``/``F.desc`` and their like of one."""
    text = item if isinstance(item, str) else re.fullmatch(r"Column<'(.*)'>", str(item), re.S)[1]
    name, way, nulls = re.fullmatch(r"`?(.*?)`?(?: (ASC|DESC)(?: NULLS (FIRST|LAST))?)?", text, re.S).groups()
    if name.lower() not in df.columns:
        raise ValueError(f"sort by columns, not by {text}")
    return name.lower(), way == "DESC", (nulls or ("LAST" if way == "DESC" else "FIRST")) == "FIRST"


def with_sorted_row_numbers(df: DataFrame, *order: str | Column, parts: int = RANGES) -> DataFrame:
    """``$row`` from 1, in any order of columns.

    A sample gives the values that cut the rows into ranges. Each row finds its range by binary search, ranges are numbered
    by one task each, and begin after the rows of those before, which are counted for themselves. Nothing is written. Rows that
    agree in all sort columns are in one range and get their numbers in any order, so add columns that tell them apart. One job
    runs at once, for the sample; rows have to be the same whenever they are read.
    """
    rows = lower_names(df)
    orders = [_ordering(rows, item) for item in order]
    keys = rows.select(*[F.col(f"`{name}`").alias(f"k{i}") for i, (name, _, _) in enumerate(orders)])
    # of each slot of hashes the value with the least second hash: a bounded sample of a table of any size
    slot = F.pmod(F.xxhash64(*keys.columns), F.lit(parts * PER_RANGE))
    sampled = keys.groupBy(slot.alias("_slot")).agg(F.min_by(F.struct(*keys.columns), F.xxhash64(F.lit("second"), *keys.columns)).alias("k"))
    sign = [F.col(f"k.k{i}").desc_nulls_first() if d and n else F.col(f"k.k{i}").desc() if d else F.col(f"k.k{i}").asc() if n else F.col(f"k.k{i}").asc_nulls_last()
            for i, (_, d, n) in enumerate(orders)]
    found = sampled.select("k").orderBy(*sign).select(F.to_json("k", {"ignoreNullFields": "false"}).alias("t"), "k").collect()
    cuts = list(dict.fromkeys(found[i * len(found) // parts]["t"] for i in range(1, parts) if found))
    splits = F.from_json(F.lit("[" + ",".join(cuts) + "]"), T.ArrayType(keys.schema))

    def before(split: Column) -> Column:
        """The split is not after the row."""
        out = F.lit(True)
        for i, (name, down, nulls_first) in reversed(list(enumerate(orders))):
            own, cut = F.col(f"`{name}`"), split[f"k{i}"]
            first, second = (own, cut) if down else (cut, own)
            differ = F.when(own.isNull(), F.lit(not nulls_first)).when(cut.isNull(), F.lit(nulls_first)).otherwise(first < second)
            out = F.when(own.eqNullSafe(cut), out).otherwise(differ)
        return out

    ranged = rows.withColumn("_range", range_of(splits, len(cuts), before))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # one row a range
    starts = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_start"))
    within = Window.partitionBy("_range").orderBy(*order)
    placed = ranged.withColumn("_place", F.row_number().over(within)).join(starts, "_range")
    return placed.withColumn(ROW_NUMBER, F.col("_start") + F.col("_place")).drop("_range", "_place", "_start")
