"""Keyed state of streams: batches closed by the clock, hot keys, numbering over epochs, a user's state."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice import session
from sluice.sinks.tables import read_epochs, write_epoch
from sluice.streaming import state

KEYED = "key string, order bigint, time bigint, value string"


def numbers(rows, max_count, max_millis):
    """Batch number per (key, order), one row after the other."""
    out, open_ = {}, {}
    for key, order, at, *_ in rows:
        batch, n, first = open_.get(key, (-1, 0, 0))
        if n == 0 or n >= max_count or (max_millis > 0 and at - first >= max_millis):
            batch, n, first = batch + 1, 0, at
        open_[key] = (batch, n + 1, first)
        out[key, order] = batch
    return out


def epochs_of(spark, rows, cuts):
    """Rows as files of a folder, one a micro-batch, in order."""
    path = session.shared_dir(spark, "keyed")
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        spark.createDataFrame(rows[a:b], KEYED).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.01)
    return spark.readStream.schema(KEYED).option("maxFilesPerTrigger", "1").parquet(path)


def run(stream, base, each=None):
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", f"{base}/checkpoint")
    each = each or (lambda rows, epoch: write_epoch(rows, f"{base}/rows", "p", epoch))
    writer.foreachBatch(each).trigger(availableNow=True).start().awaitTermination()


@pytest.mark.parametrize(("max_count", "max_millis"), [(4, 50), (7, 0), (1000, 300), (3, 10**9)])
def test_numbers_go_on_over_epochs(spark, max_count, max_millis):
    draw = random.Random(max_count)
    rows = [(draw.choice(["a", "b", None]), i, i * 5 + draw.randrange(40), "v") for i in range(400)]
    base = session.shared_dir(spark, "numbered")
    numbered = state.NumberedBatches(base, ["key"], "order", "time", max_count, max_millis, block_rows=16)
    run(epochs_of(spark, rows, [50, 51, 180, 320]), base, numbered)
    got = numbered.rows(spark, f"{KEYED}, batch bigint").collect()
    assert {(r["key"], r["order"]): r["batch"] for r in got} == numbers(rows, max_count, max_millis)
    assert len({r["epoch"] for r in got}) == 5


def test_a_replayed_epoch_numbers_the_same(spark):
    rows = [("a", i, i, "v") for i in range(10)]
    frame = spark.createDataFrame(rows, KEYED)
    numbered = state.NumberedBatches(session.shared_dir(spark, "numbered"), ["key"], "order", "time", 4, 0)
    for epoch, low in ((0, 0), (1, 5), (1, 5)):
        numbered(frame.where(f"order >= {low} AND order < {low + 5}"), epoch)
    got = numbered.rows(spark, f"{KEYED}, batch bigint").collect()
    assert sorted((r["order"], r["batch"]) for r in got) == [(i, i // 4) for i in range(10)]


def test_closings_agree_with_one_row_after_the_other():
    draw = random.Random(3)
    for _ in range(200):
        times = np.array([draw.randrange(500) for _ in range(draw.randrange(1, 200))])
        count, millis, n, first = draw.randrange(1, 90), draw.choice([0, 30, 200, 10**6]), 0, 0
        if draw.random() < 0.5 and count > 1:
            n, first = draw.randrange(1, count), draw.randrange(500)
        ends, reasons = state.closings(times, n, first, count, millis)
        want, taken, since = [], n, first
        for i, t in enumerate(times):
            if taken and millis and t - since >= millis:
                want.append((i, "time"))
                taken = 0
            if taken == 0:
                since = t
            taken += 1
            if taken == count:
                want.append((i + 1, "count"))
                taken = 0
        assert list(zip(ends, reasons)) == want


def test_a_hot_key_in_one_micro_batch_goes_through_in_frames(spark):
    path, base = session.shared_dir(spark, "hot"), session.shared_dir(spark, "hot-out")
    n = 1_000_000
    spark.range(0, n, 1, 4).select(F.lit("hot").alias("key"), F.col("id").alias("order"), F.col("id").alias("time"), F.lit("v").alias("value")).write.parquet(path)
    run(state.live_batches(spark.readStream.schema(KEYED).parquet(path), 30_000, 0, live=False), base)
    sizes = read_epochs(spark, f"{base}/rows", state.CLOSED).groupBy("batch").agg(F.count("*").alias("n"), F.count_distinct("order").alias("d")).collect()
    assert {(r["n"], r["d"]) for r in sizes} == {(30_000, 30_000)} and len(sizes) == n // 30_000


def test_a_hot_key_is_numbered_by_all_tasks(spark):
    base = session.shared_dir(spark, "hot")
    rows = spark.range(0, 1_000_000, 1, 4).select(F.lit("hot").alias("key"), F.col("id").alias("order"), (F.col("id") * 3).alias("time"), F.lit("v").alias("value"))
    numbered = state.NumberedBatches(base, ["key"], "order", "time", 1000, 600, block_rows=1 << 14)
    numbered(rows, 0)
    got = numbered.rows(spark, f"{KEYED}, batch bigint")
    assert got.where("batch != order div 200").count() == 0 and got.count() == 1_000_000
    left = numbered.carried(spark, 0).collect()
    assert [(r["key"], r["batch"], r["n"], r["first"]) for r in left] == [("hot", 4999, 200, 2_999_400)]


def test_a_batch_closes_by_the_clock_without_a_further_record(spark):
    base = session.shared_dir(spark, "clock")
    stream = epochs_of(spark, [("a", 1, 10, "x"), ("a", 2, 11, "y"), ("b", 3, 12, "z")], [])
    closed = state.live_batches(stream, 100, 1500)
    query = closed.writeStream.outputMode("append").option("checkpointLocation", f"{base}/checkpoint").foreachBatch(
        lambda rows, epoch: write_epoch(rows, f"{base}/rows", "p", epoch)).trigger(processingTime="200 milliseconds").start()
    try:
        deadline, got = time.time() + 60, []
        while len(got) < 3 and time.time() < deadline:
            time.sleep(0.5)
            got = read_epochs(spark, f"{base}/rows", state.CLOSED).collect()
    finally:
        query.stop()
    assert sorted((r["key"], r["batch"], r["order"], r["value"], r["closed"]) for r in got) == [
        ("a", 0, 1, "x", "timer"), ("a", 0, 2, "y", "timer"), ("b", 0, 3, "z", "timer")]


def remembered(key, rows, cache):
    """What the key's last row of an earlier micro-batch was, and how many there were."""
    before = cache.get("last")
    count = int(cache.get("count", "0"))
    for row in rows:
        count += 1
        cache["last"] = row["value"]
    cache["count"] = str(count)
    yield key, before, count, ",".join(sorted(cache))


def test_a_value_of_the_first_epoch_is_read_in_the_third_and_after_a_restart(spark):
    base, path = session.shared_dir(spark, "user"), session.shared_dir(spark, "user-in")
    schema = "key string, before string, n bigint, names string"
    source = spark.readStream.schema(KEYED).option("maxFilesPerTrigger", "1").parquet
    for rows in ([("a", 1, 0, "first")], [("b", 2, 0, "other")], [("a", 3, 0, "second")]):
        spark.createDataFrame(rows, KEYED).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.01)
    run(state.with_state(source(path), remembered, schema), base)
    spark.createDataFrame([("a", 4, 0, "third")], KEYED).coalesce(1).write.mode("append").parquet(path)
    run(state.with_state(source(path), remembered, schema), base)
    got = read_epochs(spark, f"{base}/rows", schema).orderBy("epoch").collect()
    assert [(r["epoch"], r["key"], r["before"], r["n"], r["names"]) for r in got] == [
        (0, "a", None, 1, "count,last"), (1, "b", None, 1, "count,last"), (2, "a", "first", 2, "count,last"), (3, "a", "second", 3, "count,last")]


class _Value:
    """A value or a list of a state store, in memory."""

    def __init__(self):
        self.kept = []

    def exists(self):
        return bool(self.kept)

    def get(self):
        return self.kept[0] if len(self.kept) == 1 and isinstance(self.kept[0][0], int) and len(self.kept[0]) == 4 else iter(self.kept)

    def update(self, value):
        self.kept = [value]

    def appendList(self, values):
        self.kept += values

    def clear(self):
        self.kept = []


@pytest.mark.parametrize(("max_count", "max_millis"), [(4, 0), (30, 60), (1, 0)])
def test_batches_that_a_frame_closes_leave_as_one_frame(max_count, max_millis):
    import pandas as pd

    draw = random.Random(max_count)
    rows = [("a", i, i * 5 + draw.randrange(40), f"v{i}") for i in range(500)]
    live = state.LiveBatches(max_count, max_millis, False)
    live.open, live.held = _Value(), _Value()
    frames = [pd.DataFrame(rows[a:b], columns=["key", "order", "time", "value"]) for a, b in ((0, 2), (2, 300), (300, 500))]
    made = list(live.handleInputRows(("a",), iter(frames), None))
    assert len(made) <= len(frames)
    found = [tuple(r) for m in made for r in m[["key", "order", "batch", "value"]].itertuples(index=False)]
    want = numbers(rows, max_count, max_millis)
    assert found == [("a", i, want["a", i], f"v{i}") for i in range(len(found))]
    assert found and len(found) >= 500 - max_count
