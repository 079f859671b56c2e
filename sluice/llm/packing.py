"""Packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups.

Documents are tokenised and cut: whole sequences' worth of tokens become full sequences at once, and only
the remainder of each document is packed. Remainders are dealt at random into groups of bounded size and
every group is packed on its own, so no task sees more than a group and the padding is that of
first-fit decreasing over thousands of pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sluice.llm.shared import staged, text_or_empty

LENGTH = 2048
END = 1
# Pieces that one group is meant to hold; a piece is shorter than a sequence, which bounds a group's memory.
GROUP_PIECES = 8192
# Distinct words whose ids a worker remembers.
CACHE_WORDS = 1 << 20


class Bins:
    """Open bins under a tournament tree: each inner node knows the most room below it."""

    def __init__(self, capacity: int, most: int):
        self.size = 1 << max(0, (most - 1).bit_length())
        self.room = np.zeros(2 * self.size, dtype=np.int64)
        self.room[self.size:self.size + most] = capacity
        for i in range(self.size - 1, 0, -1):
            self.room[i] = max(self.room[2 * i], self.room[2 * i + 1])
        self.tree = self.room.tolist()

    def place(self, length: int) -> int:
        """The first bin with room for the length, which it takes."""
        tree, node = self.tree, 1
        while node < self.size:
            node *= 2
            if tree[node] < length:
                node += 1
        at = node - self.size
        tree[node] -= length
        while node > 1:
            node //= 2
            most = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == most:
                break
            tree[node] = most
        return at


def first_fit_decreasing(lengths: list[int], capacity: int = LENGTH) -> list[int]:
    """The bin of each length; longest first, equal lengths in the given order."""
    bins, placed = Bins(capacity, max(1, len(lengths))), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        placed[i] = bins.place(lengths[i])
    return placed


class Words(dict):
    """Token ids of white-space separated words as bytes; a worker keeps them from task to task."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # what stands for a token of its own wherever a text has it
        self.marks = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        ids = self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
        found = self[word] = np.array(ids, dtype="<u4").tobytes()
        return found


@cache
def words_of(path: str) -> Words:
    return Words(path)


def token_ids(words: Words, text: str) -> np.ndarray:
    """The tokenizer lower-cases and drops white space before it merges, so a text's ids are those of its words in turn.

    A text that has the spelling of a special token, in any case, is left to the tokenizer as a whole.
    """
    low = text.encode().lower()
    if any(mark in low for mark in words.marks):
        return np.array([*words.tokenizer.encode(text, add_special_tokens=False).ids, END], "<u4")
    found = b"".join(map(words.__getitem__, low.split()))
    return np.append(np.frombuffer(found, "<u4"), np.uint32(END))


def _pieces(batches: Iterator[pd.DataFrame], path: str, length: int) -> Iterator[pd.DataFrame]:
    words = words_of(path)
    for batch in batches:
        out = []
        for row, (doc, text) in enumerate(zip(batch["doc_id"], batch["text"], strict=True)):
            ids = token_ids(words, text)
            full = len(ids) - len(ids) % length
            for start in range(0, len(ids), length):
                piece = ids[start:start + length]
                rest = start >= full
                out.append((doc, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), rest))
        frame = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "_rest"])
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        yield frame


def packed(docs: DataFrame, tokenizer: str, length: int = LENGTH, text_column: str = "text",
           id_column: str = "doc_id") -> DataFrame:
    """One row per piece of a document, with its sequence and place there.

    A null or empty text is the end token alone. Repeated rows are packed like any others, a null id is
    kept, an empty table gives no rows. ``sequence_id`` is unique but not dense.
    """
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), text_or_empty(text_column).alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, _rest boolean"
    pieces = rows.mapInPandas(lambda batches: _pieces(batches, tokenizer, length), schema)
    table = staged(pieces.withColumn("_rid", F.monotonically_increasing_id()), "pieces")
    rests = table.where("_rest")
    groups = max(1, -(-rests.count() // GROUP_PIECES))

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "_rid"], ascending=[False, True], kind="stable")
        sequence = np.array(first_fit_decreasing(frame["length"].tolist(), length), dtype=np.int64)
        order = np.argsort(sequence, kind="stable")
        frame, sequence = frame.iloc[order], sequence[order]
        ends = np.cumsum(frame["length"].to_numpy())
        starts = ends - frame["length"].to_numpy()
        first = np.searchsorted(sequence, sequence, side="left")
        # the smallest row number of a sequence's pieces names it
        names = frame["_rid"].groupby(sequence).transform("min")
        return frame.assign(sequence_id=names.to_numpy(), offset=starts - starts[first]).drop(columns=["_rid", "_group"])

    columns = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    grouped = rests.withColumn("_group", F.pmod(F.xxhash64("_rid"), F.lit(groups))).drop("_rest")
    ends = grouped.groupBy("_group").applyInPandas(pack, columns)
    full = table.where("NOT _rest").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.col("_rid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return full.unionByName(ends)
