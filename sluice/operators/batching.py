"""Batches by count, or by count or time, and grouping of batches by topic."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sluice.operators.ranking import BUCKET_WIDTH, LEVELS, whole, with_position
from sluice.session import written

# Default size and age limit of a batch.
MAX_COUNT = 1000
MAX_MILLIS = 10_000

BLOCK_ROWS = 1 << 18
RUN_BLOCKS = 1 << 10


def chunks(df: DataFrame, order: str, max_count: int = MAX_COUNT, name: str = "chunk",
           width: int = BUCKET_WIDTH, totals_from: DataFrame | None = None, levels: int = LEVELS) -> DataFrame:
    """Cut the whole stream, in arrival order, into chunks of ``max_count`` records."""
    placed = with_position(df, [], order, "_position", width, levels, totals_from)
    return placed.withColumn(name, whole(F.col("_position"), max_count)).drop("_position")


def count_batches(df: DataFrame, keys: list[str], order: str, max_count: int = MAX_COUNT, name: str = "batch",
                  width: int = BUCKET_WIDTH, levels: int = LEVELS) -> DataFrame:
    """Cut each key, in order, into batches of ``max_count`` records."""
    placed = with_position(df, keys, order, "_position", width, levels)
    return placed.withColumn(name, whole(F.col("_position"), max_count)).drop("_position")


def by_topic(df: DataFrame, message: Column, chunk: str = "chunk", topic: str = "topic") -> DataFrame:
    """One row per (chunk, topic) with its messages in order; never more than a chunk holds.

    ``message`` is a struct whose first fields give the order.
    """
    return df.groupBy(chunk, topic).agg(
        F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(message)).alias("messages")
    )


def batch_text(topic: Column, messages: Column, partition: str = "partition", offset: str = "offset") -> Column:
    """``Batch for topic of n : [partition:offset, ...]``, messages sorted by partition."""
    ordered = F.sort_array(F.transform(messages, lambda m: F.struct(m[partition].alias("p"), m[offset].alias("o"))))
    places = F.transform(ordered, lambda m: F.concat_ws(":", m["p"].cast("string"), m["o"].cast("string")))
    return F.concat(
        F.lit("Batch for "), topic, F.lit(" of "), F.size(messages).cast("string"), F.lit(" : ["),
        F.array_join(places, ", "), F.lit("]"),
    )


def _ends(times: np.ndarray, size: int, max_count: int, max_millis: int) -> np.ndarray:
    """Where the batch that starts at each of the first ``size`` rows ends (start of the next batch).

    That is the first later row that is old enough, whatever the order of times: runs of 2^k rows whose
    latest time is too early are skipped, longest first.
    """
    latest = [times]
    while 2 << (len(latest) - 1) <= min(max_count, len(times)):
        half = 1 << (len(latest) - 1)
        latest.append(np.maximum(latest[-1][:-half], latest[-1][half:]))
    ends, limit = np.arange(1, size + 1), times[:size] + max_millis
    for k in reversed(range(len(latest))):
        fits = ends < len(latest[k])
        early = fits & (latest[k][np.where(fits, ends, 0)] < limit)
        ends = np.where(early, ends + (1 << k), ends)
    return np.minimum(ends, np.arange(size) + max_count)


def _transfer(max_count: int, max_millis: int):
    """Per block: for each possible first batch start, where the next block's first batch starts."""

    def transfer(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("_position", kind="stable")
        size = int((~block["_halo"]).sum())
        ends = _ends(block["_time"].to_numpy(), size, max_count, max_millis)
        batches = np.ones(size, dtype=np.int64)
        # each turn doubles how many batches are followed at once
        while (inside := ends < size).any():
            at = ends[inside]
            batches[inside], ends[inside] = batches[inside] + batches[at], ends[at]
        out = block.head(1).drop(columns=["_position", "_time", "_halo"])
        out["_leave"], out["_batches"] = [(ends[:max_count] - size).tolist()], [batches[:max_count].tolist()]
        return out

    return transfer


def _compose(blocks: pd.DataFrame) -> pd.DataFrame:
    """Per run of blocks: the run as one block."""
    blocks = blocks.sort_values("_block")
    tables = list(zip(blocks["_leave"], blocks["_batches"]))
    at = np.arange(len(tables[0][0]))
    count = np.zeros(len(at), dtype=np.int64)
    for leave, batches in tables:
        # past the end of the last, short block nothing more starts
        open_ = at < len(leave)
        inside = np.where(open_, at, 0)
        count += np.where(open_, np.asarray(batches)[inside], 0)
        at = np.where(open_, np.asarray(leave)[inside], 0)
    out = blocks.head(1).drop(columns=["_block", "_leave", "_batches"])
    out["_leave"], out["_batches"] = [at.tolist()], [count.tolist()]
    return out


def _follow(order: str):
    """Follow blocks in order, from a known first batch start, to each block's own."""

    def follow(blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values(order)
        entry = int(blocks["_entry"].iloc[0]) if "_entry" in blocks else 0
        number = int(blocks["_number"].iloc[0]) if "_number" in blocks else 0
        entries, numbers = [], []
        for leave, batches in zip(blocks["_leave"], blocks["_batches"]):
            entries.append(entry)
            numbers.append(number)
            if entry < len(leave):
                entry, number = int(leave[entry]), number + int(batches[entry])
        out = blocks.drop(columns=["_leave", "_batches"])
        out["_entry"], out["_number"] = entries, numbers
        return out

    return follow


def _assign(max_count: int, max_millis: int):
    """Per block: number the batches, given where the block's first batch starts."""

    def assign(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("_position", kind="stable")
        size = int((~block["_halo"]).sum())
        ends = _ends(block["_time"].to_numpy(), size, max_count, max_millis)
        start, number = int(block["_entry"].iloc[0]), int(block["_number"].iloc[0])
        starts = np.array([start] if start < size else [], dtype=np.int64)
        # each turn doubles how many starts are known
        while len(further := ends[starts][ends[starts] < size]):
            starts = np.concatenate([starts, further])
            ends = np.where(ends < size, ends[np.minimum(ends, size - 1)], ends)
        batch = number - 1 + np.cumsum(np.bincount(starts, minlength=size))
        kept = [c for c in block.columns if c.startswith("_key")] + ["_position"]
        return block.loc[~block["_halo"], kept].assign(_batch=batch)

    return assign


def _carry(placed: DataFrame, carried: DataFrame | None, key: list[str], max_count: int, max_millis: int) -> DataFrame | None:
    """Per key with an open batch: how many rows that one still takes, and the number of the batch after it."""
    if carried is None:
        return None
    closes = F.col("_position") + F.col("n") >= max_count
    if max_millis > 0:
        closes = closes | (F.col("_time") - F.col("first") >= max_millis)
    near = placed.where(F.col("_position") < max_count).join(carried, key) if key else placed.where(F.col("_position") < max_count).join(carried)
    return near.groupBy(*key, "batch").agg(
        F.coalesce(F.min(F.when(closes, F.col("_position"))), F.count(F.lit(1))).alias("_entry")
    ).select(*key, "_entry", (F.col("batch") + 1).alias("_number"))


def count_or_time_batches(df: DataFrame, keys: list[str], order: str, time: str, max_count: int = MAX_COUNT,
                          max_millis: int = MAX_MILLIS, name: str = "batch", block_rows: int = BLOCK_ROWS,
                          run_blocks: int = RUN_BLOCKS, width: int = BUCKET_WIDTH, levels: int = LEVELS,
                          carried: DataFrame | None = None) -> DataFrame:
    """Cut each key into batches that close at ``max_count`` rows or ``max_millis`` after their first row.

    Each batch start depends on the one before, so the rule is sequential per key. To keep a hot key
    out of a single task its rows are cut into blocks. A block's first batch can only start at one of
    its first ``max_count`` rows; every block works out, for each of these, where it leaves off. These
    tables are composed per run of blocks, the runs of a key are chained with one lookup each, then
    the blocks of each run, and all blocks number their rows in parallel. A block also sees the
    ``max_count`` rows after it, because its last batch may reach over its end.

    ``time`` is in milliseconds, in any order: a batch closes at the first row whose time is
    ``max_millis`` after that of its first. ``max_millis=0`` means count only. A NULL key is a key like any
    other, a NULL order comes first; a block has at least ``max_count`` rows. The rows with their positions are
    written once and read back for each step.

    ``carried`` (keys, batch, n, first) is the open batch that earlier rows of a key left: its number,
    its rows and the time of its first. The first rows go on filling it, and numbers go on from there.
    """
    if max_millis <= 0 and carried is None:
        return count_batches(df, keys, order, max_count, name, width, levels)
    block_rows = max(block_rows, max_count)
    columns = [F.col(f"`{c}`") for c in df.columns]
    # all keys as one text, which is never NULL, so that joins keep rows with NULL keys
    key_names = ["_key"] if keys else []

    def keyed(rows: DataFrame) -> DataFrame:
        named = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
        return rows.withColumn("_key", F.to_json(F.to_variant_object(named))) if keys else rows

    placed = written(with_position(keyed(df), keys, order, "_position", width, levels), "positions")
    slim = placed.select(*key_names, "_position", F.col(time).cast("bigint").alias("_time"))
    if carried is not None:
        carried = keyed(carried).select(*key_names, "batch", "n", "first")
    if max_millis <= 0:
        return _counted_on(placed, carried, key_names, max_count, name).select(*columns, name)
    types = {f.name: f.dataType.simpleString() for f in slim.schema}
    types |= dict.fromkeys(["_block", "_run", "_entry", "_number", "_batch"], "bigint")
    types |= dict.fromkeys(["_leave", "_batches"], "array<bigint>") | {"_halo": "boolean"}

    def ddl(*names: str) -> str:
        return ", ".join(f"{n} {types[n]}" for n in (*key_names, *names))

    home = whole(F.col("_position"), block_rows)
    reaches_back = (F.col("_position") % block_rows < max_count) & (home > 0)
    blocks = slim.withColumn("_home", home)
    blocks = blocks.withColumn("_block", F.explode(F.when(reaches_back, F.array(home, home - 1)).otherwise(F.array(home))))
    blocks = blocks.withColumn("_halo", F.col("_block") != F.col("_home")).drop("_home")
    blocks = blocks.withColumn("_run", whole(F.col("_block"), run_blocks))

    block_key, run_key = [*key_names, "_run", "_block"], [*key_names, "_run"]
    # one row a block: cheap to keep, and the blocks themselves are not gone through again
    tables = written(blocks.groupBy(*block_key).applyInPandas(
        _transfer(max_count, max_millis), ddl("_block", "_run", "_leave", "_batches")
    ), "transfers")
    runs = tables.groupBy(*run_key).applyInPandas(_compose, ddl("_run", "_leave", "_batches"))
    if (entry := _carry(slim, carried, key_names, max_count, max_millis)) is not None:
        runs = runs.join(entry, key_names, "left") if key_names else runs.join(entry, how="left")
        runs = runs.fillna(0, ["_entry", "_number"])
    run_entries = runs.groupBy(*key_names).applyInPandas(_follow("_run"), ddl("_run", "_entry", "_number"))
    entries = tables.join(run_entries, run_key).groupBy(*run_key).applyInPandas(
        _follow("_block"), ddl("_run", "_block", "_entry", "_number")
    )
    numbered = blocks.join(entries, block_key).groupBy(*block_key).applyInPandas(
        _assign(max_count, max_millis), ddl("_position", "_batch")
    )
    return placed.join(numbered, [*key_names, "_position"]).select(*columns, F.col("_batch").alias(name))


def _counted_on(placed: DataFrame, carried: DataFrame, key: list[str], max_count: int, name: str) -> DataFrame:
    """Batches by count alone that go on from open ones."""
    joined = placed.join(carried.select(*key, F.col("batch").alias("_from"), F.col("n").alias("_taken")), key, "left") if key else placed.join(
        carried.select(F.col("batch").alias("_from"), F.col("n").alias("_taken")), how="left")
    place = F.col("_position") + F.coalesce("_taken", F.lit(0))
    return joined.withColumn(name, F.coalesce("_from", F.lit(0)) + whole(place, max_count))


def open_batches(numbered: DataFrame, keys: list[str], order: str, time: str, carried: DataFrame | None = None, name: str = "batch") -> DataFrame:
    """The last batch of each key (keys, batch, n, first), to be carried to later rows of the key.

    ``carried`` is what was carried to these rows; keys without rows keep theirs.
    """
    each = numbered.groupBy(*keys, F.col(name).alias("batch")).agg(
        F.count(F.lit(1)).alias("n"), F.min_by(F.col(time).cast("bigint"), order).alias("first"))
    last = each.groupBy(*keys).agg(F.max_by(F.struct("batch", "n", "first"), "batch").alias("_new"))
    if carried is None:
        return last.select(*keys, "_new.*")
    old = carried.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], F.struct("batch", "n", "first").alias("_old"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_{i}"))
    both = last.join(old, same, "full")
    kept = F.when(F.col("_new").isNull(), F.col("_old")).when(
        F.col("_new.batch") == F.col("_old.batch"),
        F.struct(F.col("_new.batch").alias("batch"), (F.col("_new.n") + F.col("_old.n")).alias("n"), F.col("_old.first").alias("first")),
    ).otherwise(F.col("_new"))
    names = [F.when(F.col("_new").isNull(), F.col(f"_{i}")).otherwise(F.col(k)).alias(k) for i, k in enumerate(keys)]
    return both.select(*names, kept.alias("_kept")).select(*keys, "_kept.*")
