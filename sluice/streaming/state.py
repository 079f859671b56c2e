"""Keyed state in streams: a cache kept between batches, and batches closed by count or time."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator, MutableMapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sluice.operators import batching
from sluice.operators.batching import BLOCK_ROWS
from sluice.sinks.tables import read_epochs, write_epoch

# the state worker next to the driver is not given shipped packages, so these classes travel by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# keeps state out of the executors' heap; transformWithState needs it
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def cached(stream: DataFrame) -> DataFrame:
    """Count and latest value per key, kept between the batches of a stream (key, value, order).

    Emits the keys that changed. The built-in aggregation folds before its shuffle, so a hot key costs
    one row per input partition.
    """
    use_rocksdb(stream.sparkSession)
    return stream.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max_by("value", "order").alias("latest"))


# what the batch that is open now left: its number, its rows, the time of its first row, when its timer is due
OPEN_BATCH = "batch bigint, n bigint, first bigint, due bigint"
HELD = "order bigint, value string"
CLOSED = "key string, batch bigint, order bigint, value string, closed string"


def closings(times: np.ndarray, n: int, first: int, max_count: int, max_millis: int) -> tuple[list[int], list[str]]:
    """Before which rows batches close, and why, when one with ``n`` rows since ``first`` is open (none: n is 0)."""
    ends, reasons, start = [], [], 0
    while start < len(times):
        first = first if n else int(times[start])
        full = start + max_count - n
        end, why = full, "count"
        if max_millis > 0:
            # looked for in stretches, so that rows are not looked at again for each batch
            at, step = start, 64
            while at < min(full, len(times)):
                old = np.flatnonzero(times[at:min(at + step, full)] - first >= max_millis)
                if len(old):
                    end, why = at + int(old[0]), "time"
                    break
                at, step = at + step, 2 * step
        if end > len(times):
            break
        ends.append(end)
        reasons.append(why)
        n, start = 0, end
    return ends, reasons


class LiveBatches(StatefulProcessor):
    """Per key: collects records until their batch closes, by count, by a record old enough or by the clock."""

    def __init__(self, max_count: int, max_millis: int, live: bool) -> None:
        self.max_count, self.max_millis, self.live = max_count, max_millis, live

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", OPEN_BATCH)
        self.held = handle.getListState("held", HELD)

    def _taken(self) -> list:
        held = list(self.held.get()) if self.held.exists() else []
        self.held.clear()
        return held

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Frames come one by one, and the batches that one closes leave as one; only the open batch is held, which is smaller than a full one."""
        number, n, first, due = self.open.get() if self.open.exists() else (0, 0, 0, 0)
        for frame in rows:
            orders, values, times = frame["order"].tolist(), frame["value"].tolist(), frame["time"].to_numpy()
            ends, reasons = closings(times, n, first, self.max_count, self.max_millis)
            start = 0
            if ends:
                held, start = self._taken(), ends[-1]
                sizes = np.diff([0, *ends])
                sizes[0] += len(held)
                yield pd.DataFrame({
                    "key": key[0], "batch": np.repeat(np.arange(number, number + len(ends)), sizes), "order": [h[0] for h in held] + orders[:start],
                    "value": [h[1] for h in held] + values[:start], "closed": np.repeat(np.array(reasons, object), sizes)})
                number, n, due = number + len(ends), 0, self._without_timer(due)
            if start < len(times):
                if n == 0:
                    first = int(times[start])
                n += len(times) - start
                self.held.appendList(list(zip(orders[start:], values[start:])))
                if self.live and not due:
                    due = timerValues.getCurrentProcessingTimeInMs() + self.max_millis
                    self.handle.registerTimer(due)
        self.open.update((number, n, first, due))

    def _without_timer(self, due: int) -> int:
        if due:
            self.handle.deleteTimer(due)
        return 0

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        number, n, _, due = self.open.get()
        if n and due and due <= timerValues.getCurrentProcessingTimeInMs():
            held = self._taken()
            yield pd.DataFrame({"key": key[0], "batch": number, "order": [h[0] for h in held], "value": [h[1] for h in held], "closed": "timer"})
            self.open.update((number + 1, 0, 0, 0))

    def close(self) -> None:
        pass


def live_batches(stream: DataFrame, max_count: int, max_millis: int, live: bool = True) -> DataFrame:
    """Records of a stream (key, order, time, value) once their batch closes: (key, batch, order, value, closed).

    Records count as they arrive. A batch closes at ``max_count`` records, before a record whose time is ``max_millis``
    after that of its first, or, when ``live``, ``max_millis`` of the clock after its first record came, without any
    further record; ``closed`` says which (count, time, timer). ``max_millis=0`` means count only. A key's records go through
    one task, frame by frame; ``NumberedBatches`` spreads a hot key over tasks but has no clock.
    """
    use_rocksdb(stream.sparkSession)
    live = live and max_millis > 0
    return stream.select("key", "order", "time", "value").groupBy("key").transformWithStateInPandas(
        LiveBatches(max_count, max_millis, live), CLOSED, "append", "processingTime" if live else "none"
    )


@dataclass
class NumberedBatches:
    """Numbers a stream's rows by batch, for ``foreachBatch``: each micro-batch goes on from the open batches of the last.

    A micro-batch is numbered in blocks by all tasks, also when it is one key's. The open batch of each key seen so far is one row of
    a table that is written for each epoch in one of two places by turns, so a replayed epoch finds what its first run found.
    """

    base: str
    keys: list[str]
    order: str
    time: str
    max_count: int
    max_millis: int
    block_rows: int = BLOCK_ROWS

    def _open(self, epoch: int) -> str:
        return f"{self.base}/open/turn={epoch % 2}"

    def carried(self, spark: SparkSession, epoch: int) -> DataFrame | None:
        """What an epoch left open; None if it never ran."""
        try:
            left = spark.read.parquet(self._open(epoch)).where(F.col("epoch") == epoch).drop("epoch")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return left

    def __call__(self, rows: DataFrame, epoch: int) -> None:
        carried = self.carried(rows.sparkSession, epoch - 1)
        numbered = batching.count_or_time_batches(
            rows, self.keys, self.order, self.time, self.max_count, self.max_millis, block_rows=self.block_rows, carried=carried)
        write_epoch(numbered, f"{self.base}/rows", "batches", epoch)
        done = rows.sparkSession.read.schema(numbered.schema).parquet(f"{self.base}/rows/pipeline=batches/epoch={epoch}")
        left = batching.open_batches(done, self.keys, self.order, self.time, carried)
        left.withColumn("epoch", F.lit(epoch).cast("bigint")).write.mode("overwrite").parquet(self._open(epoch))

    def rows(self, spark: SparkSession, schema: str) -> DataFrame:
        return read_epochs(spark, f"{self.base}/rows", schema)


# A user's update: (key, rows, state) to rows. The state outlives the micro-batch and a restart.
Update = Callable[[str, Iterator[Row], MutableMapping[str, str]], Iterable[tuple]]


class UserCache(MutableMapping):
    """A key's state as a mapping of names to texts."""

    def __init__(self, state) -> None:
        self.state = state

    def __getitem__(self, name: str) -> str:
        if not self.state.containsKey((name,)):
            raise KeyError(name)
        return self.state.getValue((name,))[0]

    def __setitem__(self, name: str, value: str) -> None:
        self.state.updateValue((name,), (value,))

    def __delitem__(self, name: str) -> None:
        self[name]
        self.state.removeKey((name,))

    def __iter__(self) -> Iterator[str]:
        return (k[0] for k in self.state.keys())

    def __len__(self) -> int:
        return sum(1 for _ in self)


class UserState(StatefulProcessor):
    """Runs a user's update on each key's new rows with what earlier rows of the key left."""

    def __init__(self, update: Update, names: list[str]) -> None:
        self.update, self.names = update, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("cache", "name string", "value string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for made in self.update(key[0], rows, UserCache(self.state)):
            yield Row(**dict(zip(self.names, made)))

    def close(self) -> None:
        pass


def with_state(stream: DataFrame, update: Update, schema: str, key: str = "key") -> DataFrame:
    """What a user's update makes of each key's rows, with a mapping per key that it may read and write.

    Rows come one at a time, in the order they arrive in. The mapping (names to texts) is kept in the state store, with the stream's checkpoint;
    only the entries that the update touches are read. ``schema`` describes the rows that it yields.
    """
    use_rocksdb(stream.sparkSession)
    struct = T._parse_datatype_string(schema)
    return stream.groupBy(key).transformWithState(UserState(update, struct.names), struct, "append", "none")
