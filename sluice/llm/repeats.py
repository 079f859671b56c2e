"""Long repeated byte strings across documents, found in suffix order with longest-previous-factor arrays.

A string of ``width`` bytes starts at every byte. Each start belongs to an anchor: the first of the smallest hashed
k-grams inside its string, so equal strings have equal anchors at the same place. An anchor's key (the k-gram's hash)
that stands once settles all its starts at once, and so do equal contexts (all bytes of the starts of an anchor).
Only different contexts of one key are compared: tasks take whole keys, sort the starts of their contexts in suffix
order by prefix doubling, find for each the previous and next smaller text position there, and these give the longest
previous factor, here as far as ``width``. Keys with very many contexts are settled start by start instead, by
128-bit hashes that Spark groups, so that no task ever holds a key of unbounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from sluice.llm.shared import numbered, staged, text_or_empty

WIDTH = 400
# bytes of a k-gram; the longer, the fewer keys are shared by chance, but the more anchors there are
GRAM = 96
# starts that are hashed at once, contexts' bytes that are sorted at once, contexts of a key that one task may hold
SEGMENT, CHUNK, HOT = 1 << 21, 1 << 22, 1 << 12
PLACE_BITS = 22
# bytes that are ranked as one number before the first doubling, and so the least width
LEAST = 8
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every bit of the input reaches every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(2)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""

    def powers(b: int) -> np.ndarray:
        steps = np.full(size, b, U)
        steps[0] = 1
        return np.multiply.accumulate(steps)

    return powers(base), powers(pow(base, -1, 1 << 64))


class Hashes:
    """64-bit hashes of any substrings of some bytes."""

    def __init__(self, data: np.ndarray, base: int = BASES[0]) -> None:
        room = 1 << max(SEGMENT + 4096, len(data)).bit_length()
        power, self.inverse = _powers(base, room)
        values = _mix(np.arange(1, 257, dtype=U) * U(base))[data] * power[: len(data)]
        self.sums = np.concatenate([np.zeros(1, U), np.cumsum(values, dtype=U)])

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of the bytes from each first up to, not including, each last."""
        return _mix((self.sums[last] - self.sums[first]) * self.inverse[first])

    def grams(self, size: int) -> np.ndarray:
        count = len(self.sums) - size
        return _mix((self.sums[size:] - self.sums[:count]) * self.inverse[:count])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    span, least = 1, values
    while 2 * span <= width:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    rest = width - span
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def _pieces(texts: pa.Array, width: int) -> Iterator[list[tuple[int, int, memoryview]]]:
    """(row, offset, bytes) of texts and of parts of long ones, as many at once as a segment holds; strings never cross pieces."""
    group, size = [], 0
    for row, text in enumerate(texts):
        data = memoryview(text.as_buffer()) if text.is_valid else memoryview(b"")
        for at in range(0, len(data) - width + 1, SEGMENT):
            piece = data[at:at + SEGMENT + width - 1]
            if size + len(piece) > SEGMENT + width and group:
                yield group
                group, size = [], 0
            group.append((row, at, piece))
            size += len(piece)
    if group:
        yield group


def anchored(pieces: list[tuple[int, int, memoryview]], width: int, gram: int) -> dict[str, np.ndarray]:
    """The runs of string starts that share an anchor: row, first start, starts, the anchor's place, key, context, how often in a row."""
    data = np.concatenate([np.frombuffer(p, np.uint8) for _, _, p in pieces])
    sizes = np.array([len(p) for _, _, p in pieces])
    ends = np.cumsum(sizes)
    hashes = Hashes(data)
    keys = hashes.grams(gram)
    places = np.arange(len(keys), dtype=U)
    low = U((1 << PLACE_BITS) - 1)
    anchor = (sliding_least((keys & ~low) | places, width - gram + 1) & low).astype(np.int64)
    piece = np.repeat(np.arange(len(sizes)), sizes)[: len(anchor)]
    starts = np.flatnonzero(np.arange(len(anchor)) + width <= ends[piece])
    own = anchor[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    first, count = starts[at], np.diff(np.append(at, len(starts)))
    off = own[at] - first
    context = hashes.of(first, first + count - 1 + width)
    context = _mix(context ^ (count.astype(U) * U(BASES[1])) ^ (off.astype(U) << U(40)))
    key, of = keys[own[at]], piece[first]
    # a text of one short period has the same run again and again
    again = np.zeros(len(at), bool)
    again[1:] = (key[1:] == key[:-1]) & (context[1:] == context[:-1]) & (of[1:] == of[:-1]) & (first[1:] == first[:-1] + count[:-1])
    head = np.flatnonzero(~again)
    base = ends[of] - sizes[of]
    offset = np.array([o for _, o, _ in pieces])[of]
    rows = np.array([r for r, _, _ in pieces])[of]
    return {"row": rows[head], "start": (first - base + offset)[head], "starts": count[head], "off": off[head], "key": key.view(np.int64)[head],
            "context": context.view(np.int64)[head], "times": np.diff(np.append(head, len(at)))}


ANCHOR = "rid long, start long, starts int, off int, key long, context long, times long"


def _anchors(width: int, gram: int) -> Callable:
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pieces in _pieces(batch.column(1), width):
                found = anchored(pieces, width, gram)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(found["row"])), pa.array(found["start"]), pa.array(found["starts"], pa.int32()),
                    pa.array(found["off"], pa.int32()), pa.array(found["key"]), pa.array(found["context"]), pa.array(found["times"]),
                ], ["rid", "start", "starts", "off", "key", "context", "times"])

    return anchors


def suffix_ranks(data: np.ndarray, width: int) -> Callable[[np.ndarray], np.ndarray]:
    """By prefix doubling: for places, numbers that order the strings of ``width`` bytes there, and are equal for equal strings."""
    size = len(data)
    ranks = np.zeros(size, U)
    for i in range(LEAST):
        ranks[: size - i] |= data[i:].astype(U) << U(8 * (LEAST - 1 - i))
    ranks, span = np.unique(ranks, return_inverse=True)[1].astype(np.int64), LEAST
    while 2 * span <= width:
        pairs = ranks << 32
        pairs[: size - span] |= ranks[span:]
        ranks, span = np.unique(pairs, return_inverse=True)[1].astype(np.int64), 2 * span
    return lambda places: (ranks[places] << 32) | ranks[places + width - span]


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """Per place the nearest earlier place with a smaller value, or -1: all candidates jump at once to their own candidates."""
    found = np.arange(-1, len(values) - 1)
    open_ = np.flatnonzero(found >= 0)
    while len(open_):
        open_ = open_[values[found[open_]] > values[open_]]
        found[open_] = found[found[open_]]
        open_ = open_[found[open_] >= 0]
    return found


def previous_factors(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per string start in text order: whether its longest previous factor reaches the whole width, and whether it is one itself.

    In suffix order the previous and the next smaller text position have the longest common prefixes with a start among
    all earlier ones, so no other needs a look.
    """
    order = np.argsort(ranks, kind="stable")
    sorted_ = ranks[order]
    last = len(order) - 1
    before = previous_smaller(order)
    after = last - previous_smaller(order[::-1])[::-1]
    later, source = np.zeros(len(order), bool), np.zeros(len(order), bool)
    for near, there in ((before, before >= 0), (after, after <= last)):
        at = np.flatnonzero(there)
        at = at[sorted_[at] == sorted_[near[at]]]
        later[order[at]] = True
        source[order[near[at]]] = True
    return later, source


def _runs(flags: np.ndarray, owner: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, first and last start of each run of flagged starts."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at, at
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])
    first, last = at[new], at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
    return owner[first], starts[first], starts[last]


MARK = "rid long, first long, last long"
CONTEXT = "key long, copied boolean, rid long, start long, starts int, bytes binary"


def _marked(rows: pa.Table, width: int, keep_first: bool) -> pa.RecordBatch:
    """Marks of the contexts of whole keys."""
    rows = rows.sort_by([("rid", "ascending"), ("start", "ascending")])
    data = np.frombuffer(b"".join(rows["bytes"].to_pylist()), np.uint8)
    starts = rows["starts"].to_numpy().astype(np.int64)
    sizes = starts + width - 1
    owner = np.repeat(np.arange(len(starts)), starts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(starts) - starts, starts)
    places = (np.cumsum(sizes) - sizes)[owner] + within
    later, source = previous_factors(suffix_ranks(data, width)(places))
    flags = later if keep_first else later | source | rows["copied"].to_numpy(zero_copy_only=False)[owner]
    of, first, last = _runs(flags, owner, rows["start"].to_numpy()[owner] + within)
    return pa.RecordBatch.from_arrays([pa.array(rows["rid"].to_numpy()[of]), pa.array(first), pa.array(last)], ["rid", "first", "last"])


def _compared(width: int, keep_first: bool) -> Callable:
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; whole keys are put together until there is enough for one sort."""
        held, size = [], 0
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for part in np.split(np.arange(len(keys)), np.flatnonzero(keys[1:] != keys[:-1]) + 1):
                rows = batch.slice(part[0], len(part))
                if size > CHUNK and held[-1].column(0)[-1].as_py() != keys[part[0]]:
                    yield _marked(pa.Table.from_batches(held), width, keep_first)
                    held, size = [], 0
                held.append(rows)
                size += int(pc.sum(pc.binary_length(rows.column(5))).as_py())
        if held:
            yield _marked(pa.Table.from_batches(held), width, keep_first)

    return compared


def _windows(width: int) -> Callable:
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each string start of a context by itself, with two hashes of its string."""
        for batch in batches:
            for row in batch.to_pylist():
                data, at = np.frombuffer(row["bytes"], np.uint8), np.arange(row["starts"])
                one, two = (Hashes(data, base).of(at, at + width).view(np.int64) for base in BASES)
                same = lambda v, t: pa.array([v] * len(at), t)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one), pa.array(two), same(row["copied"], pa.bool_()), same(row["rid"], pa.int64()), pa.array(at + row["start"])],
                    ["one", "two", "copied", "rid", "first"])

    return windows


def _hot_marks(contexts: DataFrame, width: int, keep_first: bool) -> DataFrame:
    rows = contexts.mapInArrow(_windows(width), "one long, two long, copied boolean, rid long, first long")
    groups = rows.groupBy("one", "two").agg(
        F.count("*").alias("_n"), F.max("copied").alias("_copied"), F.min(F.struct("rid", "first")).alias("_least"))
    own = rows.join(groups, ["one", "two"])
    found = F.struct("rid", "first") != F.col("_least") if keep_first else (F.col("_n") > 1) | F.col("_copied")
    return own.where(found).select("rid", "first", F.col("first").alias("last"))


def _cut(width: int) -> Callable:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of contexts, from their texts."""
        names = ["key", "copied", "rid", "start", "starts"]
        for batch in batches:
            for i in range(len(batch)):
                rid, data, wanted = batch.column(0)[i].as_py(), memoryview(batch.column(1)[i].as_buffer()), batch.column(2)[i].values
                cols = {n: wanted.field(n) for n in ("key", "copied", "start", "starts")}
                cols["rid"] = pa.array([rid] * len(wanted), pa.int64())
                parts = [bytes(data[s:s + n + width - 1]) for s, n in zip(cols["start"].to_pylist(), cols["starts"].to_pylist())]
                yield pa.RecordBatch.from_arrays([cols[n] for n in names] + [pa.array(parts, pa.binary())], names + ["bytes"])

    return cut


def marks(texts: DataFrame, width: int = WIDTH, gram: int = GRAM, keep_first: bool = False, hot: int = HOT) -> DataFrame:
    """Runs of starts (rid, first, last) of strings of ``width`` bytes that also start elsewhere, in a table (rid, text as bytes).

    With ``keep_first`` only those that also start earlier, by number and place. Runs of a row do not overlap, but may touch.
    """
    anchors = staged(texts.mapInArrow(_anchors(width, gram), ANCHOR), "repeats-anchors")
    place = F.struct("rid", "start")
    keys = anchors.groupBy("key").agg(F.sum("times").alias("_all"), F.min("context").alias("_low"), F.max("context").alias("_high"), F.min(place).alias("_key_first"))
    shared = staged(anchors.join(keys.where("_all > 1").select("key", (F.col("_low") < F.col("_high")).alias("_mixed"), "_key_first"), "key"), "repeats-shared")
    mixed = shared.where("_mixed")
    groups = staged(mixed.groupBy("key", "context").agg(
        F.sum("times").alias("_n"), F.min(F.struct("rid", "start", "starts")).alias("_first")), "repeats-contexts")

    whole = F.col("start") + F.col("times") * F.col("starts") - 1
    alone = shared.where("NOT _mixed").select("*", F.col("_key_first").alias("_first"))
    copies = mixed.join(groups.where("_n > 1").select("key", "context", F.struct("_first.rid", "_first.start").alias("_first")), ["key", "context"])
    sure = alone.select("rid", "start", "starts", "times", "_first").unionAll(copies.select("rid", "start", "starts", "times", "_first"))
    # of the first copy only the first run may be kept
    begin = F.col("start") + F.when(F.lit(keep_first) & (place == F.col("_first")), F.col("starts")).otherwise(0)
    sure = sure.select("rid", begin.alias("first"), whole.alias("last")).where("first <= last")

    many = groups.groupBy("key").agg(F.count("*").alias("_contexts")).where(F.col("_contexts") > hot).select("key", F.lit(True).alias("_hot"))
    wanted = groups.join(many, "key", "left").select(
        F.col("_first.rid").alias("rid"), F.struct(
            "key", (F.col("_n") > 1).alias("copied"), F.col("_first.start").alias("start"), F.col("_first.starts").alias("starts")).alias("_wanted"),
        F.col("_hot").isNotNull().alias("_hot"))
    lists = wanted.groupBy("rid", "_hot").agg(F.collect_list("_wanted").alias("_wanted"))
    cut = lambda hot_ones: texts.join(lists.where("_hot" if hot_ones else "NOT _hot"), "rid").select("rid", "text", "_wanted").mapInArrow(_cut(width), CONTEXT)
    compared = cut(False).repartition("key").sortWithinPartitions("key").mapInArrow(_compared(width, keep_first), MARK)
    out = sure.unionAll(compared)
    if not many.isEmpty():
        out = out.unionAll(_hot_marks(staged(cut(True), "repeats-hot"), width, keep_first))
    return out


def _removed(width: int) -> Callable:
    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, all_spans, kept = [], [], []
            for text, runs in zip(batch.column(1), batch.column(2).to_pylist()):
                data, spans = memoryview(text.as_buffer()), []
                for run in sorted(runs or (), key=lambda r: r["first"]):
                    if spans and run["first"] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], run["last"] + width)
                    else:
                        spans.append([run["first"], run["last"] + width])
                edges = [0, *(e for s in spans for e in s), len(data)]
                sizes.append(len(data))
                all_spans.append(spans)
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(sizes, pa.int64()), pa.array(all_spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())],
                ["_id", "n_bytes", "spans", "kept"])

    return removed


def repeats_removed(docs: DataFrame, text_column: str = "text", id_column: str = "doc_id", width: int = WIDTH, gram: int = GRAM,
                    keep: str = "first", hot: int = HOT) -> DataFrame:
    """Per row: its id, ``n_bytes``, the removed ``spans`` (pairs of first byte and byte after the last) and the ``kept`` bytes.

    Texts are UTF-8 bytes; strings never cross texts. Removed is every byte covered by a string of ``width`` bytes that
    also starts earlier (``keep="first"``: by the staged row's number, then place) or anywhere else (``keep="none"``), be it in the
    same text. Strings are judged on the input; what is left may begin or end inside a character, hence bytes. A null text is
    empty; texts shorter than ``width`` stay whole, repeated rows are copies of each other, ids may be null or repeat, and texts may be of
    any length (long ones are read in overlapping segments). An empty table gives no rows. Other columns are not read.
    """
    if keep not in ("first", "none"):
        raise ValueError("keep is 'first' or 'none'")
    if not LEAST <= gram <= width:
        raise ValueError(f"gram is {LEAST} at least and width at most")
    texts = numbered(docs.select(F.col(f"`{id_column}`").alias("_id"), text_or_empty(text_column).cast("binary").alias("text")), "repeats-input", "rid")
    own = texts.select("rid", "text")
    found = staged(marks(own, width, gram, keep == "first", hot), "repeats-marks")
    lists = found.groupBy("rid").agg(F.collect_list(F.struct("first", "last")).alias("_runs"))
    joined = texts.join(lists, "rid", "left").select("_id", "text", "_runs")
    id_type = docs.schema[id_column].dataType.simpleString()
    out = joined.mapInArrow(_removed(width), f"_id {id_type}, n_bytes long, spans array<array<bigint>>, kept binary")
    return out.withColumnRenamed("_id", id_column)
