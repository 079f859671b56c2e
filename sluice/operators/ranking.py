"""Exact positions, predecessors and newest-N lists that no single hot key can turn into one big task.

A plain window over a key puts all rows of that key in one task. These operators cut every key's order
into buckets, work per (key, bucket), and carry only one aggregated row per bucket across buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKET_WIDTH = 1 << 14
# Bucket totals are themselves summed up in buckets of this many, this many times.
FANOUT = 1 << 16
LEVELS = 1
SALTS = 64
# Ranges of a sketched order column, and the sketch's accuracy as a multiple of them.
PARTS = 1 << 10
ACCURACY = 20
KEY = ["_keys"]


def whole(value: Column, width: int) -> Column:
    """Integer division."""
    return F.call_function("div", value, F.lit(width))


def order_splits(df: DataFrame, order: str, parts: int = PARTS) -> list[int]:
    """Values that cut an integral order column into ranges of about equally many rows, from one quantile sketch.

    With these, bucket sizes do not depend on how densely the numbers lie.
    """
    shares = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(F.col(order).cast("bigint"), shares, ACCURACY * parts)).first()[0]
    return sorted(set(found or []))


def range_of(splits: Column, count: int, before: Callable[[Column], Column]) -> Column:
    """How many of ``count`` ascending splits are not after a row, by binary search: ``before`` says so of one split."""
    steps = F.from_json(F.lit(str([1 << k for k in reversed(range(count.bit_length()))])), "array<int>")

    def step(found: Column, more: Column) -> Column:
        split = F.get(splits, found + more - 1)
        return F.when(split.isNotNull() & before(split), found + more).otherwise(found)

    return F.aggregate(steps, F.lit(0), step) if count else F.lit(0)


def _bucket(order: str, width: int, splits: Sequence[int] | None = None) -> Column:
    # never NULL, so that no join adds a null filter and all levels can share one exchange of totals
    if splits is None:
        return F.coalesce(whole(F.col(order), width), F.lit(0).cast("bigint"))
    array = F.from_json(F.lit(str(list(splits))), "array<bigint>")
    found = range_of(array, len(splits), lambda s: s <= F.col(order))
    # the first range is NULL's too, which stands before all numbers
    return F.coalesce(found, F.lit(0)).cast("bigint")


def _keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys as one struct: it is never NULL itself, so joins on it keep rows with NULL keys and shuffle no more."""
    return df.withColumn(KEY[0], F.struct(*keys)) if keys else df


def with_sum_before(df: DataFrame, keys: Sequence[str], order: str, value: Column, name: str,
                    width: int = BUCKET_WIDTH, levels: int = LEVELS, totals_from: DataFrame | None = None,
                    splits: Sequence[int] | None = None) -> DataFrame:
    """Add the sum of ``value`` over the preceding rows of the same key; 0 for the first.

    Rows are shuffled once, on (keys, bucket). Bucket totals come from a separate narrow scan with
    partial aggregation; their own running sums are taken the same way, one level up. ``order`` is
    integral and unique within a key, so a bucket holds at most ``width`` rows of a key. This suits
    dense numbers such as offsets. For sparse ones, such as hashes, pass ``splits`` from ``order_splits``:
    a bucket then holds its share of all rows. NULL is a key like any other. When ``df`` is expensive,
    ``totals_from`` names a cheaper table of the same rows.
    """
    totals = None if totals_from is None else _keyed(totals_from, keys)
    levels = levels if splits is None else 0
    return _sum_before(_keyed(df, keys), KEY[:len(keys)], order, value, name, width, levels, totals, splits).drop(*KEY)


def _sum_before(df: DataFrame, keys: Sequence[str], order: str, value: Column, name: str, width: int, levels: int,
                totals_from: DataFrame | None = None, splits: Sequence[int] | None = None) -> DataFrame:
    bucket, start = f"_bucket{levels}", f"_start{levels}"
    group = [*keys, bucket]
    rows = df.withColumn(bucket, _bucket(order, width, splits))
    source = rows if totals_from is None else totals_from.withColumn(bucket, _bucket(order, width, splits))
    totals = source.groupBy(*group).agg(F.sum(value).alias("_total"))
    if levels > 0:
        starts = _sum_before(totals, keys, bucket, F.col("_total"), start, FANOUT, levels - 1)
    else:
        before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
        starts = totals.withColumn(start, F.coalesce(F.sum("_total").over(before), F.lit(0)))
    within = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_local", F.coalesce(F.sum(value).over(within), F.lit(0)))
    joined = local.join(starts.select(*group, start), group)
    return joined.withColumn(name, F.col(start) + F.col("_local")).drop(bucket, start, "_local")


def with_position(df: DataFrame, keys: Sequence[str], order: str, name: str = "position",
                  width: int = BUCKET_WIDTH, levels: int = LEVELS, totals_from: DataFrame | None = None,
                  splits: Sequence[int] | None = None) -> DataFrame:
    """Add the 0-based position of each row within its key, by a unique integral order column."""
    return with_sum_before(df, keys, order, F.lit(1).cast("bigint"), name, width, levels, totals_from, splits)


def with_previous(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str = "previous",
                  width: int = BUCKET_WIDTH, levels: int = LEVELS, splits: Sequence[int] | None = None) -> DataFrame:
    """Add the value of the preceding row of the same key, NULL for the first.

    Within a bucket this is a plain lag; the first row of a bucket takes the last value of the key's
    preceding bucket, found the same way among one row per bucket. NULL is a key like any other.
    """
    levels = levels if splits is None else 0
    return _previous(_keyed(df, keys), KEY[:len(keys)], order, value, name, width, levels, splits).drop(*KEY)


def _previous(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str, width: int, levels: int,
              splits: Sequence[int] | None = None) -> DataFrame:
    bucket, carry = f"_bucket{levels}", f"_carry{levels}"
    group = [*keys, bucket]
    rows = df.withColumn(bucket, _bucket(order, width, splits)).withColumn("_boxed", F.struct(F.col(value).alias("v")))
    last = rows.groupBy(*group).agg(F.max_by("_boxed", order).alias("_last"))
    if levels > 0:
        carried = _previous(last, keys, bucket, "_last", carry, FANOUT, levels - 1)
    else:
        carried = last.withColumn(carry, F.lag("_last").over(Window.partitionBy(*keys).orderBy(bucket)))
    local = rows.withColumn("_local", F.lag("_boxed").over(Window.partitionBy(*group).orderBy(order)))
    joined = local.join(carried.select(*group, carry), group)
    return joined.withColumn(name, F.coalesce("_local", carry)["v"]).drop(bucket, carry, "_local", "_boxed")


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, spread: str, name: str = "rank",
           salts: int = SALTS) -> DataFrame:
    """The first ``n`` rows of each key in the given order, ranked from 1.

    Spark limits each window group before its shuffle. The first limit runs per (key, salt of the
    ``spread`` column), so the survivors of a hot key are spread out, and the last one sees at most
    ``salts * n`` rows of a key.
    """
    keys = list(keys)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    first = salted.withColumn("_rank", F.row_number().over(part)).where(F.col("_rank") <= n)
    whole = Window.partitionBy(*keys).orderBy(*order)
    ranked = first.withColumn(name, F.row_number().over(whole)).where(F.col(name) <= n)
    return ranked.drop("_salt", "_rank")
