"""N-gram Jaccard join: documents linked by the overlap of their word shingles, exactly, and their groups.

Sets are ordered by a global order of shingles, rarest first as far as a fixed-size table of counts over
all documents tells; only the first part of a set is indexed (prefix), with positions and sizes. Of index
lists with the same members one is kept, that of the shingle that comes first. Lists are cut into blocks by
size; the size and position of an entry say which sizes it can still be linked with, so a join skips all
other blocks.

Set relations do the rest. In each list a pivot's answers are computed first, then it leaves the list; the
pivot is the set with the fewest rarer shingles before the list's own: what tells copies apart few others have,
so it is the one nearest to all of them. A set that is linked with the pivot takes over the pivot's
group, so pairs inside a group are never formed, however many near copies it has. The answers of others are
derived from the pivot's: their overlaps with the pivot bound their overlap with each other from both sides,
which settles most pairs without a look at them. Turns go on for as long as each leaves at most half of the
pairs; then the rest is formed pair by pair. Counts of shingles by part of the hash range bound overlaps once
more, in more parts the larger a set is; pairs that stay are compared shingle by shingle. Pairs that would carry
more counts or texts than all documents have are looked at in rounds, so disk follows the documents and not the pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from sluice.llm.components import components
from sluice.llm.shared import discarded, fresh, numbered, staged

WORDS = 4
PERCENT = 85
# Pivots' turns come to an end when one leaves more than this part of the pairs that the last one left.
PAYING = 0.5
# Shingle counts are kept for this many hashed buckets; only their magnitude counts, and only for the order.
COUNT_BITS = 17
# Shingles of a set are also counted by so many parts of the hash range at least and at most, to bound overlaps;
# in between a part has up to so many shingles, or large sets that have nothing in common would look alike.
PARTS, MOST_PARTS, PART_SHINGLES = 128, 1 << 16, 16
# For each shingle of all sets, the shingles of texts and the bytes of counts that one round of pairs carries.
ROUND_SHINGLES, ROUND_BYTES = 0.5, 2
CACHE_WORDS = 1 << 20
# fixed values: odd multipliers that spread 64-bit numbers
_SPREAD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


class WordNumbers(dict):
    """64-bit numbers of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        number = self[word] = xxhash.xxh64_intdigest(word)
        return number


@cache
def word_numbers() -> WordNumbers:
    """A worker keeps them from task to task."""
    return WordNumbers()


def shingle_numbers(text: str | None, numbers: WordNumbers, width: int = WORDS) -> np.ndarray:
    """A text's shingles in turn as 64-bit numbers; words are split at ASCII white space, A-Z lower-cased."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    coded = np.fromiter(map(numbers.__getitem__, words), np.uint64, len(words))
    spread = [np.uint64(_SPREAD[i % 4] * (1 + 2 * (i // 4)) % (1 << 64)) for i in range(width)]
    if len(words) < width:
        mixed = np.zeros(1, np.uint64)
        for i in range(len(coded)):
            part = coded[i:i + 1]
            mixed += (part ^ (part >> np.uint64(31))) * spread[i]
        mixed += np.uint64(len(words))
    else:
        count = len(words) - width + 1
        mixed = np.zeros(count, np.uint64)
        for i in range(width):
            part = coded[i:i + count]
            mixed += (part ^ (part >> np.uint64(31))) * spread[i]
    mixed ^= mixed >> np.uint64(33)
    mixed *= _MIX
    mixed ^= mixed >> np.uint64(29)
    return mixed


def shingles(text: str | None, numbers: WordNumbers, width: int = WORDS) -> np.ndarray:
    """The set of a text's shingles, sorted."""
    return np.unique(shingle_numbers(text, numbers, width))


def set_key(numbers: np.ndarray) -> bytes:
    """Names a set: equal sets have equal keys."""
    return hashlib.md5(numbers.tobytes()).digest()


def prefix_length(size: int, percent: int) -> int:
    """A set and any set linked with it share a shingle among the first so many of either."""
    return size - -(-percent * size // 100) + 1


def part_count(size: int) -> int:
    """Parts of the hash range for a set of this size, a power of two."""
    return min(max(PARTS, 1 << (-(-size // PART_SHINGLES) - 1).bit_length()), MOST_PARTS) if size else PARTS


def part_counts(found: np.ndarray) -> bytes:
    """A set's shingles by part, in numbers of as few bytes as the largest needs."""
    parts = part_count(len(found))
    counts = np.bincount((found % np.uint64(parts)).astype(np.int64), minlength=parts)
    return counts.astype(np.min_scalar_type(counts.max()).newbyteorder("<")).tobytes()


def most_shared(x: bytes, nx: int, y: bytes, ny: int) -> int:
    """Two sets' overlap is at most the sum of the smaller counts, over the parts of the one that has fewer."""
    a, b = (np.frombuffer(p, f"<u{len(p) // part_count(n)}") for p, n in ((x, nx), (y, ny)))
    parts = min(len(a), len(b))
    a, b = (c if len(c) == parts else c.reshape(-1, parts).sum(axis=0) for c in (a, b))
    return int(np.minimum(a, b).sum())


def shingle_magnitudes(docs: DataFrame, text: str, width: int) -> np.ndarray:
    """How often the shingles of each hashed bucket occur in all documents, as a power of two."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers, total = word_numbers(), np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            found = np.concatenate([shingle_numbers(value, numbers, width) for value in batch["text"]])
            total += np.bincount((found >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=len(total))
        buckets = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": buckets, "n": total[buckets]})

    texts = docs.select(F.col(f"`{text}`").cast("string").alias("text"))
    rows = texts.mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    magnitudes = np.zeros(1 << COUNT_BITS, np.uint8)
    magnitudes[rows["bucket"].to_numpy(np.int64)] = np.log2(rows["n"].to_numpy(np.float64)).astype(np.uint8) + 1
    return magnitudes


def with_sets(docs: DataFrame, magnitudes: np.ndarray, columns: list[Column], schema: str, width: int, percent: int) -> DataFrame:
    """The given columns of each document, its set's size and key, its first shingles in order, and its counts by part."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = word_numbers()
        for batch in batches:
            sizes, keys, firsts, parts = [], [], [], []
            for value in batch["_text"]:
                found = shingles(value, numbers, width)
                keep = prefix_length(len(found), percent) if len(found) else 0
                level = magnitudes[(found >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]
                order = np.argsort(level, kind="stable")[:keep]
                sizes.append(len(found))
                keys.append(set_key(found))
                firsts.append(found[order].view(np.int64))
                parts.append(part_counts(found))
            yield batch.drop(columns="_text").assign(_n=sizes, _key=keys, _first=firsts, _parts=parts)

    return docs.select(*columns).mapInPandas(build, f"{schema}, _n long, _key binary, _first array<long>, _parts binary")


def possible(a: str, b: str, percent: int) -> Column:
    """Length and position filters for two index entries of one shingle."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    follow = F.least(n - F.col(f"{a}.at"), m - F.col(f"{b}.at"))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (100 * follow + follow * percent >= percent * (n + m))


def size_block(size: Column, percent: int) -> Column:
    """Sizes by powers of the largest ratio that linked sets can have."""
    return F.floor(F.log(size.cast("double")) / math.log(100 / percent)).cast("int")


def blocks_in_reach(entries: DataFrame, percent: int) -> DataFrame:
    """Each entry once for each block (``block``) that holds sizes it can be linked with, given its size and position."""
    n, at = F.col("n"), F.col("at")
    low = F.ceil(percent * n / 100)
    high = F.least(F.floor(100 * n / percent), F.floor((100 + percent) * (n - at) / percent) - n)
    return entries.where(high >= low).withColumn("block", F.explode(F.sequence(size_block(low, percent), size_block(high, percent))))


def met(x: DataFrame, y: DataFrame, percent: int, more: Column | None = None) -> DataFrame:
    """Pairs (x, y) of entries of one list and of different groups that may be linked, and their sizes; ``sure`` ones are.

    ``o`` is an entry's overlap with the list's last pivot, where it was computed, ``pn`` that pivot's size. Two sets
    share at most what both share with the pivot and what both have beside it, and at least what the pivot has no room
    to hold apart.
    """
    a, b = x.withColumn("block", size_block(F.col("n"), percent)).alias("x"), blocks_in_reach(y, percent).alias("y")
    xo, yo, xn, yn = F.col("x.o"), F.col("y.o"), F.col("x.n"), F.col("y.n")
    most = F.least(xo, yo) + F.least(xn - xo, yn - yo)
    reaches = F.coalesce((100 + percent) * most >= percent * (xn + yn), F.lit(True))
    on = (F.col("x.token") == F.col("y.token")) & (F.col("x.block") == F.col("y.block"))
    on = on & (F.col("x.g") != F.col("y.g")) & possible("x", "y", percent) & reaches
    if more is not None:
        on = on & more
    sure = F.coalesce((100 + percent) * (xo + yo - F.col("x.pn")) >= percent * (xn + yn), F.lit(False))
    pairs = a.join(b, on).select(F.col("x.nid").alias("x"), F.col("y.nid").alias("y"), xn.alias("nx"), yn.alias("ny"), sure.alias("sure"))
    return pairs.groupBy("x", "y", "nx", "ny").agg(F.max("sure").alias("sure"))


def in_rounds(pairs: DataFrame, weight: Column, room: float) -> Iterator[DataFrame]:
    """The pairs (x, y) in as many parts as it takes for each to weigh about ``room`` at most."""
    rounds = max(1, math.ceil((pairs.agg(F.sum(weight)).first()[0] or 0) / max(1, room)))
    for i in range(rounds):
        yield pairs.where(F.pmod(F.xxhash64("x", "y"), F.lit(rounds)) == i) if rounds > 1 else pairs


def plausible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose counts by part leave room for the overlap a link needs."""

    def side(of: DataFrame, name: str) -> DataFrame:
        return of.join(nodes.select(F.col("nid").alias(name), F.col("parts").alias(f"{name}_p")), name)

    def bounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            most = np.array([most_shared(r.x_p, r.nx, r.y_p, r.ny) for r in batch.itertuples(index=False)], np.int64)
            yield batch.loc[(100 + percent) * most >= percent * (batch["nx"] + batch["ny"]).to_numpy(np.int64), ["x", "y", "nx"]]

    return side(side(pairs, "x"), "y").mapInPandas(bounded, "x long, y long, nx int")


def compared(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The overlap of each pair (x, y) of nodes, from their whole texts; many pairs may share a ``y``."""

    def side(of: DataFrame, name: str) -> DataFrame:
        return of.join(texts.select(F.col("nid").alias(name), F.col("key").alias(f"{name}_key"), F.col("text").alias(f"{name}_text")), name)

    def overlap(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers, kept = word_numbers(), {}

        def of(node: int, value: str) -> np.ndarray:
            # neighbouring rows often share a pivot
            if node not in kept:
                if len(kept) >= 64:
                    kept.clear()
                kept[node] = shingles(value, numbers, width)
            return kept[node]

        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                x, y = shingles(row.x_text, numbers, width), of(row.y, row.y_text)
                # an id that stands for several texts brings texts of other sets along
                if set_key(x) == row.x_key and set_key(y) == row.y_key:
                    both = np.searchsorted(y, x)
                    both[both == len(y)] = 0
                    out.append((row.x, row.y, len(x), len(y), int((y[both] == x).sum())))
                else:
                    kept.pop(row.y, None)
            yield pd.DataFrame(out, columns=["x", "y", "nx", "ny", "overlap"])

    both = side(side(pairs.select("x", "y"), "x"), "y")
    return both.mapInPandas(overlap, "x long, y long, nx long, ny long, overlap long").distinct()


def linked(docs: DataFrame, text_column: str = "text", id_column: str = "doc_id", width: int = WORDS,
           percent: int = PERCENT) -> DataFrame:
    """One row per row: ``doc_id``, ``n_shingles`` and ``component_id``, the smallest id its links reach.

    A null or empty text has the empty set, is linked with nothing and is its own component. Equal sets are
    one node, so copies form no pairs. Repeated rows share their component; null ids come after all others
    in choosing a component's id. An empty table gives no rows.
    """
    columns = [F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("_text")]
    sets = staged(with_sets(docs, shingle_magnitudes(docs, text_column, width), columns, "doc_id long", width, percent), "sets")
    rows, nodes = split_off(sets)
    found = groups(nodes, docs, text_column, id_column, width, percent)
    return rows.join(found, "_key", "left").select(
        "doc_id", F.col("_n").alias("n_shingles"),
        F.when(F.col("_n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def split_off(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows without their sets, and a node for each distinct set."""
    nodes = staged(sets.where("_n > 0").groupBy("_key").agg(
        F.min("doc_id").alias("doc_id"), F.first("_n").alias("n"), F.first("_first").alias("first"), F.first("_parts").alias("parts"),
    ).withColumnRenamed("_key", "key").withColumn("nid", F.monotonically_increasing_id()), "nodes")
    rows = staged(sets.drop("_first", "_parts"), "rows")
    discarded(sets)
    return rows, nodes


def index_lists(nodes: DataFrame) -> DataFrame:
    """Entries (token, nid, n, at) of the lists with more than one member; of lists with the same members the first in the order of shingles.

    The order is the same in all sets, so a pair's first common shingle stays or has a list with the same members that comes before it.
    Members are told by their number and 128 bits of hash. Most shingles are in one set only: these go before anything else is known of a list.
    """
    entries = nodes.select("nid", F.col("n").cast("int").alias("n"), F.posexplode("first").alias("at", "token"))
    common = staged(entries.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token"), "common-tokens")
    shared = staged(entries.join(common, "token", "left_semi"), "shared-entries")
    lists = shared.groupBy("token").agg(
        F.count("*").alias("c"), F.sum("at").alias("place"), F.bit_xor(F.xxhash64("nid")).alias("h1"),
        F.bit_xor(F.xxhash64("nid", F.lit(1))).alias("h2"))
    chosen = lists.groupBy("c", "h1", "h2").agg(F.min_by("token", "place").alias("token")).select("token")
    index = staged(shared.join(chosen, "token", "left_semi"), "index")
    discarded(common)
    discarded(shared)
    return index


def texts_of(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text: str, id_column: str) -> DataFrame:
    """(nid, key, text) of the nodes that have pairs; an id with several texts brings all of them."""
    texts = docs.select(F.col(f"`{id_column}`").cast("long").alias("_id"), F.col(f"`{text}`").cast("string").alias("text"))
    paired = pairs.select(F.explode(F.array("x", "y")).alias("nid")).distinct()
    known = nodes.select("nid", "key", "doc_id").join(paired, "nid", "left_semi")
    return known.join(texts, known["doc_id"].eqNullSafe(texts["_id"])).select("nid", "key", "text")


def groups(nodes: DataFrame, docs: DataFrame, text: str, id_column: str, width: int, percent: int) -> DataFrame:
    """(_key, component_id) for every nonempty set."""
    index = index_lists(nodes)
    slim = staged(nodes.drop("first"), "slim-nodes")
    discarded(nodes)
    nodes = slim
    shingled = nodes.agg(F.sum("n")).first()[0] or 0

    none = F.lit(None).cast("int")
    lists, stale = index.select("*", none.alias("o"), none.alias("pn")), [index]
    known: DataFrame | None = None
    links: DataFrame | None = None
    reached: DataFrame | None = None
    turn, before = 0, math.inf
    while True:
        grouped = _with_group(lists, links, reached, turn)
        sizes = grouped.groupBy("token", "g").agg(F.count("*").alias("c"), F.max("rank").alias("rank"), F.max_by("nid", "rank").alias("nid"))
        tops = staged(sizes.groupBy("token").agg(
            F.sum("c").alias("all"), F.sum(F.col("c") * F.col("c")).alias("squares"), F.max_by("nid", "rank").alias("top"),
            F.max_by("g", "c").alias("main")).where("all * all > squares"), "open-lists")
        left = tops.agg(F.sum((F.col("all").cast("double") * F.col("all") - F.col("squares")) / 2)).first()[0]
        if left is None:
            break
        marked = staged(grouped.join(tops, "token").select(
            "token", "nid", "n", "at", "g", "o", "pn", (F.col("nid") == F.col("top")).alias("served"),
            (F.col("g") == F.col("main")).alias("inside")), "lists")
        for table in (*stale, tops):
            discarded(table)
        by_pivots = turn < 2 or left <= PAYING * before
        pivots = marked.where("served")
        if by_pivots:
            formed = met(marked.where("NOT served"), pivots, percent)
        else:
            once = F.col("x.inside") | (F.col("x.nid") < F.col("y.nid"))
            formed = met(marked, marked.where("NOT inside"), percent, once)
        if known is not None:
            formed = formed.join(known, ["x", "y"], "left_anti")
            formed = formed.join(known.select(F.col("y").alias("x"), F.col("x").alias("y")), ["x", "y"], "left_anti")
        formed = staged(formed, "formed")
        counted = F.greatest(F.lit(PARTS), F.col("nx") * 2 / PART_SHINGLES)
        rounds = in_rounds(formed.where("NOT sure").drop("sure"), counted, ROUND_BYTES * shingled)
        pairs = reduce(DataFrame.unionAll, [staged(plausible(r, nodes, percent), "pairs") for r in rounds])
        texts = staged(texts_of(pairs, nodes, docs, text, id_column), "texts")
        rounds = in_rounds(pairs, F.col("nx"), ROUND_SHINGLES * shingled)
        answers = reduce(DataFrame.unionAll, [staged(compared(r, texts, width), "answers") for r in rounds])
        discarded(texts)
        found = answers.where(100 * F.col("overlap") >= percent * (F.col("nx") + F.col("ny") - F.col("overlap"))).select(
            F.col("x").alias("a"), F.col("y").alias("b"))
        found = found.unionByName(formed.where("sure").select(F.col("x").alias("a"), F.col("y").alias("b")))
        met_now = formed.select("x", "y")
        known = met_now if known is None else known.unionByName(met_now)
        links = found if links is None else links.unionByName(found)
        reached = components(links)
        if not by_pivots:
            break
        # a pivot has met all of its list; overlaps with it go on with the others
        of = pivots.select("token", F.col("nid").alias("pivot"))
        overlaps = answers.select(F.col("x").alias("nid"), F.col("y").alias("pivot"), F.col("overlap").cast("int").alias("o"),
                                  F.col("ny").cast("int").alias("pn"))
        lists = marked.where("NOT served").drop("o", "pn", "served", "inside", "g").join(of, "token").join(
            overlaps, ["nid", "pivot"], "left").drop("pivot")
        turn, before, stale = turn + 1, left, [marked]
    named = nodes.select("nid", "key", "doc_id")
    if reached is None:
        return named.select(F.col("key").alias("_key"), F.col("doc_id").alias("component_id"))
    grouped = named.join(reached.withColumnRenamed("node", "nid"), "nid", "left").withColumn("_g", F.coalesce("component", "nid"))
    smallest = grouped.groupBy("_g").agg(F.min("doc_id").alias("component_id"))
    return grouped.join(smallest, "_g").select(F.col("key").alias("_key"), "component_id")


def _with_group(lists: DataFrame, links: DataFrame | None, reached: DataFrame | None, turn: int) -> DataFrame:
    """Entries with their sets' groups and their rank as pivots: least position first, then most links, then by a hash, alike in all lists."""
    drawn = F.xxhash64("nid", F.lit(turn)).bitwiseAND(F.lit((1 << 32) - 1))
    near = F.shiftleft((32767 - F.least("at", F.lit(32767))).cast("long"), 47).bitwiseOR(drawn)
    if links is None:
        return lists.withColumn("g", F.col("nid")).withColumn("rank", near)
    ends = links.select(F.explode(F.array("a", "b")).alias("nid")).groupBy("nid").agg(F.count("*").alias("degree"))
    known = ends.join(reached.withColumnRenamed("node", "nid"), "nid")
    degree = F.coalesce(F.least("degree", F.lit(32767)), F.lit(0)).cast("long")
    return lists.join(known, "nid", "left").withColumn("g", F.coalesce("component", "nid")).withColumn(
        "rank", near.bitwiseOR(F.shiftleft(degree, 32))).drop("component", "degree")


def without_near_copies(docs: DataFrame, text_column: str = "text", id_column: str = "doc_id", width: int = 5,
                        percent: int = 80) -> DataFrame:
    """The table without all but one document of each group; the smallest id stays, its first row if repeated."""
    rid = fresh(docs, "_rid")
    table = numbered(docs, "near-input", rid)
    columns = [F.col(rid).alias("doc_id"), F.col(f"`{id_column}`").cast("long").alias("_name"),
               F.col(f"`{text_column}`").cast("string").alias("_text")]
    magnitudes = shingle_magnitudes(table, text_column, width)
    sets = staged(with_sets(table, magnitudes, columns, "doc_id long, _name long", width, percent), "sets")
    rows, nodes = split_off(sets)
    found = rows.join(groups(nodes, table, text_column, rid, width, percent), "_key").where("_n > 0")
    best = found.groupBy("component_id").agg(F.min(F.struct(F.col("_name").isNull(), "_name", "doc_id")).alias("b"))
    gone = found.join(best, "component_id").where(F.col("doc_id") != F.col("b.doc_id")).select(F.col("doc_id").alias(rid))
    return table.join(gone, rid, "left_anti").drop(rid)
