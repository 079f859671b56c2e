"""Sharding: the smallest capacity that fits ordered, unsplittable groups into k contiguous shards.

Groups (equal texts) are ordered by the digest of their text. A capacity is checked greedily: each shard
takes groups until the next one does not fit. The driver knows the order only as a list of digest
prefixes with their bytes; a check that depends on where inside a prefix a cut falls asks Spark for that
prefix's parts, so it fetches a few thousand numbers at a time however many groups there are.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from sluice.llm.shared import staged, text_or_empty

# Hexadecimal digits by which a prefix grows: one prefix has at most 16**STEP parts.
STEP = 3
# Rows of a shard are numbered in cells of (digest prefix, salt), so that no group lands in one task.
CELL_DIGITS, CELL_SALTS = 2, 64


class _Order:
    """The groups in digest order, as prefixes with their bytes, refined where it matters."""

    def __init__(self, groups: DataFrame):
        self.groups = groups
        self.nodes = self._parts([""])
        self._sum()

    def _parts(self, prefixes: list[str]) -> dict[str, tuple[int, bool]]:
        """The parts of these prefixes: their bytes, and whether it is one group."""
        size = len(prefixes[0]) + STEP
        found = self.groups
        if size > STEP:
            found = found.where(F.substring("_g", 1, size - STEP).isin(prefixes))
        part = found.groupBy(F.substring("_g", 1, size).alias("p"))
        rows = part.agg(F.sum("_bytes").alias("b"), F.count("*").alias("n"), F.min("_g").alias("g")).collect()
        return {(r["g"] if r["n"] == 1 else r["p"]): (r["b"], r["n"] == 1) for r in rows}

    def _sum(self) -> None:
        self.keys = sorted(self.nodes)
        self.ends = list(accumulate(self.nodes[k][0] for k in self.keys))

    def refine(self, prefixes: set[str]) -> None:
        by_length: dict[int, list[str]] = {}
        for p in prefixes:
            by_length.setdefault(len(p), []).append(p)
        for same in by_length.values():
            parts = self._parts(sorted(same))
            for p in same:
                del self.nodes[p]
            self.nodes |= parts
        self._sum()

    def shards(self, capacity: int, whole: bool) -> tuple[int, list[int], set[str]]:
        """Greedy shards: how many, the index at which each but the first begins, prefixes that a cut falls into.

        ``whole`` leaves a prefix that does not fit to the next shard; otherwise it is cut to fit exactly.
        """
        starts, inside, at, filled = [], set(), 0, 0
        total = self.ends[-1] if self.ends else 0
        n = 1
        while filled + capacity < total:
            at = bisect_right(self.ends, filled + capacity)
            key = self.keys[at]
            begins = self.ends[at - 1] if at else 0
            single = self.nodes[key][1]
            if not single and begins < filled + capacity:
                inside.add(key)
            if single or whole:
                if begins <= filled:
                    return 1 << 62, starts, inside
                filled = begins
            else:
                filled += capacity
            starts.append(at)
            n += 1
        return n, starts, inside


def smallest_capacity(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """The least capacity for which greedy filling needs at most ``shards`` shards, and each cut's first digest."""
    order = _Order(groups)
    if not order.keys:
        return 0, []
    total = order.ends[-1]
    largest = groups.agg(F.max("_bytes")).first()[0]
    low = max(-(-total // shards), largest)
    high = -(-total // shards) + largest
    while low < high:
        middle = (low + high) // 2
        if order.shards(middle, True)[0] <= shards:
            high = middle
        elif order.shards(middle, False)[0] > shards:
            low = middle + 1
        else:
            order.refine(order.shards(middle, True)[2] | order.shards(middle, False)[2])
    while inside := order.shards(low, True)[2]:
        order.refine(inside)
    return low, [order.keys[i] for i in order.shards(low, True)[1]]


def text_size(column: str = "text") -> Column:
    """UTF-8 bytes of a text plus one; one for a null."""
    return F.octet_length(text_or_empty(column)).cast("long") + 1


def sharded(docs: DataFrame, shards: int = 8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows with their shard and slot; equal texts share a shard, and the largest shard is as small as can be.

    Null and empty texts are one group, repeated rows each take a slot, an empty table gives no rows.
    Columns: the id, ``size``, ``text_crc32``, ``shard``, ``slot`` (gapless from 0 in each shard).
    """
    text = text_or_empty(text_column)
    rows = staged(docs.select(
        F.col(f"`{id_column}`").alias("doc_id"), text_size(text_column).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("_g"),
    ), "sizes")
    groups = staged(rows.groupBy("_g").agg(F.sum("size").alias("_bytes")), "groups")
    _, cuts = smallest_capacity(groups, shards)
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + F.when(F.col("_g") >= cut, 1).otherwise(0)
    cell = ["shard", "_cell", "_salt"]
    placed = rows.select(
        "*", shard.alias("shard"), F.substring("_g", 1, CELL_DIGITS).alias("_cell"),
        F.pmod(F.xxhash64("doc_id"), F.lit(CELL_SALTS)).alias("_salt"),
    )
    before = Window.partitionBy("shard").orderBy("_cell", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(*cell).agg(F.count("*").alias("_n"))
    offsets = offsets.select(*cell, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*cell).orderBy("doc_id", "_g")
    ranked = placed.withColumn("_rank", F.row_number().over(within) - 1)
    return ranked.join(offsets, cell).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_before") + F.col("_rank")).cast("long").alias("slot"))
