"""Layered ranking, batching and newest-N lists against brute force, with hot keys and tiny buckets."""

import random

import pytest
from pyspark.sql import Window, functions as F

from sluice.operators import batching, ranking
from sluice.operators.ranking import newest, with_position, with_previous


@pytest.fixture(scope="module")
def rows():
    """One key holds two thirds of the rows; order values are unique but not dense."""
    rng = random.Random(7)
    orders = rng.sample(range(5000), 600)
    time, out = 0, []
    for order in sorted(orders):
        time += rng.choice([0, 0, 1, 3, 50, 400])
        out.append((rng.choice("aaaabc"), order, time))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, o bigint, t bigint").repartition(5)


def by_key(rows):
    groups = {}
    for row in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(row[0], []).append(row)
    return groups


@pytest.mark.parametrize("width, levels", [(1, 0), (7, 1), (7, 2), (1000, 1), (1 << 18, 1)])
def test_positions(frame, rows, width, levels):
    expected = {(r[0], r[1]): i for group in by_key(rows).values() for i, r in enumerate(group)}
    ranked = with_position(frame, ["k"], "o", width=width, levels=levels)
    assert {(r["k"], r["o"]): r["position"] for r in ranked.collect()} == expected


def test_positions_without_a_key(frame, rows):
    ranked = with_position(frame, [], "o", width=16, totals_from=frame.select("o"))
    assert [r["position"] for r in ranked.orderBy("o").collect()] == list(range(len(rows)))
    assert set(ranked.columns) == {"k", "o", "t", "position"}


@pytest.mark.parametrize("width, levels", [(1, 0), (7, 1), (7, 2), (1 << 18, 1)])
def test_previous(frame, rows, width, levels):
    expected = {}
    for group in by_key(rows).values():
        for before, row in zip([None, *group], group):
            expected[row[0], row[1]] = before[2] if before else None
    seen = with_previous(frame, ["k"], "o", "t", width=width, levels=levels)
    assert {(r["k"], r["o"]): r["previous"] for r in seen.collect()} == expected


def test_previous_keeps_null_values(spark):
    frame = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("a", 3, "y")], "k string, o bigint, v string")
    seen = with_previous(frame, ["k"], "o", "v", width=1).orderBy("o").collect()
    assert [r["previous"] for r in seen] == [None, "x", None]


@pytest.mark.parametrize("salts", [1, 3, 64])
def test_newest(frame, rows, salts):
    kept = newest(frame, ["k"], [F.desc("t"), F.desc("o")], 5, "o", salts=salts)
    expected = set()
    for key, group in by_key(rows).items():
        top = sorted(group, key=lambda r: (r[2], r[1]), reverse=True)[:5]
        expected |= {(key, r[1], i + 1) for i, r in enumerate(top)}
    assert {(r["k"], r["o"], r["rank"]) for r in kept.collect()} == expected


def test_newest_is_limited_before_the_shuffle(frame, capsys):
    newest(frame, ["k"], [F.desc("t")], 5, "o").explain()
    assert capsys.readouterr().out.count("WindowGroupLimit") == 4


def closed(rows, max_count, max_millis):
    """The batching rule, one record at a time."""
    out = {}
    for key, group in by_key(rows).items():
        batch, n, first = -1, 0, 0
        for _, order, time in group:
            if n == 0 or n >= max_count or (max_millis and time - first >= max_millis):
                batch, n, first = batch + 1, 0, time
            n += 1
            out[key, order] = batch
    return out


@pytest.mark.parametrize("max_count, max_millis", [(1, 100), (3, 0), (3, 100), (10, 1), (8, 1000), (20, 10**9), (16, 400)])
@pytest.mark.parametrize("block_rows, run_blocks", [(20, 3), (64, 2), (1 << 18, 1 << 10)])
def test_count_or_time(frame, rows, max_count, max_millis, block_rows, run_blocks):
    cut = batching.count_or_time_batches(
        frame, ["k"], "o", "t", max_count, max_millis, block_rows=block_rows, run_blocks=run_blocks, width=16
    )
    assert {(r["k"], r["o"]): r["batch"] for r in cut.collect()} == closed(rows, max_count, max_millis)


def test_blocks_hold_a_batch_at_least(frame, rows):
    cut = batching.count_or_time_batches(frame, ["k"], "o", "t", 100, 400, block_rows=50, width=16)
    assert {(r["k"], r["o"]): r["batch"] for r in cut.collect()} == closed(rows, 100, 400)


@pytest.mark.parametrize("max_count, max_millis", [(1, 100), (3, 100), (8, 1000), (20, 10**9), (16, 400), (5, 1)])
def test_count_or_time_with_times_out_of_order_and_a_null_key(spark, max_count, max_millis):
    draw = random.Random(max_count)
    rows = [(k, o * 3, draw.randrange(3000)) for k in ("a", None) for o in range(150)]
    frame = spark.createDataFrame(rows, "k string, o bigint, t bigint")
    cut = batching.count_or_time_batches(frame, ["k"], "o", "t", max_count, max_millis, block_rows=20, run_blocks=3, width=16)
    assert cut.columns == ["k", "o", "t", "batch"]
    expected = {}
    for key in ("a", None):
        expected |= {(key, o): b for (_, o), b in closed([("x", *r[1:]) for r in rows if r[0] == key], max_count, max_millis).items()}
    assert {(r["k"], r["o"]): r["batch"] for r in cut.collect()} == expected


def test_count_only_gives_34_batches_of_101_records(spark):
    frame = spark.range(101).select(F.lit("t").alias("k"), F.col("id").alias("o"))
    sizes = [r["count"] for r in batching.count_batches(frame, ["k"], "o", 3).groupBy("batch").count().collect()]
    assert len(sizes) == 34 and max(sizes) == 3


def test_batches_by_topic_and_their_text(spark):
    frame = spark.createDataFrame(
        [("alpha", 12, 100, 0), ("beta", 13, 7, 1), ("alpha", 14, 2, 2)], "topic string, offset bigint, partition int, o bigint"
    )
    message = F.struct("o", "partition", "offset")
    grouped = batching.by_topic(batching.chunks(frame, "o", 10), message)
    texts = {r["topic"]: r["text"] for r in grouped.select("topic", batching.batch_text(F.col("topic"), F.col("messages")).alias("text")).collect()}
    assert texts == {"alpha": "Batch for alpha of 2 : [2:14, 100:12]", "beta": "Batch for beta of 1 : [7:13]"}


@pytest.mark.parametrize("levels", [0, 1, 2])
def test_rows_with_null_keys_stay(spark, levels):
    rows = [("a", None, 3), (None, None, 1), (None, None, 9), (None, "x", 2), ("a", None, 70000)]
    table = spark.createDataFrame(rows, "k string, l string, o long")
    placed = with_position(table, ["k", "l"], "o", width=2, levels=levels).collect()
    assert sorted((r["o"], r["position"]) for r in placed) == [(1, 0), (2, 0), (3, 0), (9, 1), (70000, 1)]
    follow = with_previous(table, ["k", "l"], "o", "o", width=2, levels=levels).collect()
    assert sorted((r["o"], r["previous"] or 0) for r in follow) == [(1, 0), (2, 0), (3, 0), (9, 1), (70000, 3)]
    assert set(follow[0].asDict()) == {"k", "l", "o", "previous"}


def test_buckets_of_hashed_numbers_are_even(spark):
    rows = spark.range(40_000).select((F.col("id") % 3).alias("k"), F.xxhash64("id").alias("o"), F.lit("own").alias("_keys0"))
    # half of all numbers lie in a millionth of the range
    rows = rows.withColumn("o", F.when(F.col("o") % 2 == 0, F.col("o").bitwiseAND((1 << 43) - 2)).otherwise(F.col("o"))).dropDuplicates(["k", "o"])
    splits = ranking.order_splits(rows, "o", 64)
    sizes = [r["count"] for r in rows.groupBy(ranking._bucket("o", 1, splits)).count().collect()]
    assert max(sizes) <= 2 * sum(sizes) / len(sizes) and len(sizes) >= 60
    window = Window.partitionBy("k").orderBy("o")
    want = rows.select("k", "o", (F.row_number().over(window) - 1).alias("p"), F.lag("o").over(window).alias("l"))
    placed = with_position(rows, ["k"], "o", "p", splits=splits)
    follow = with_previous(rows, ["k"], "o", "o", "l", splits=splits)
    assert placed.columns == [*rows.columns, "p"]
    assert placed.join(want.select("k", "o", F.col("p").alias("w")), ["k", "o"]).where("p != w").count() == 0 and placed.count() == rows.count()
    assert follow.join(want.select("k", "o", F.col("l").alias("w")), ["k", "o"]).where("NOT l <=> w").count() == 0


def test_an_order_of_one_value_or_none_has_one_bucket(spark):
    frame = spark.createDataFrame([("a", 5), ("b", 5), ("a", None)], "k string, o bigint")
    for rows in (frame, frame.where("o IS NULL"), frame.where("false")):
        splits = ranking.order_splits(rows, "o")
        assert sorted(r["position"] for r in with_position(rows, ["k"], "o", splits=splits).collect()) == [0, 0, 1][:rows.count()]
