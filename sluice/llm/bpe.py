"""Byte-level BPE: ranked merges folded over the distinct words of blocks of documents.

Python splits texts, numbers their distinct words and looks up which runs of a word's bytes are pieces. Merging is
done by Spark's higher-order functions: the places around a word's bytes are the bits of a long, and one fold over
the word's runs in the order of their ranks clears the place inside each run that is two neighbours at that moment.
Python then reads the pieces between the places that are left. A block is bounded by the size of its texts, so nothing
is shuffled and no vocabulary of the corpus is gathered anywhere; a word that several blocks have is merged once in each.

One pass in the order of ranks does what merging the lowest-ranked neighbours again and again does, if no merge makes
a pair of a lower rank than its own. That holds in words without ``unruly`` pieces; words with one are merged with a heap.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from sluice.llm.quality import let

# Characters of text in a block; a longer text is a block of its own.
BLOCK_CHARS = 1 << 22
# The places around the bytes of a word have to fit a long; longer words are merged with a heap in Python.
FOLD_BYTES = 62
# A run of a word's bytes, from i to before j, is the number i * PLACES + j.
PLACES = 1 << 6
MOST_RANKS = 1 << 21
# Words that are looked up at a time.
AT_ONCE = 1 << 14
# Of the hash of a node and a byte.
MULTIPLIER = 2654435761


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


@dataclass
class Trie:
    """The pieces' bytes as a trie whose children are looked up for many nodes at once, in a table with open addressing."""

    keys: np.ndarray
    children: np.ndarray
    # of each node, -1 where no piece ends
    ranks: np.ndarray
    # the node of each two bytes, -1 without one
    pairs: np.ndarray

    @classmethod
    def of(cls, ranks: dict[bytes, int]) -> Trie:
        if max(ranks.values(), default=0) >= MOST_RANKS:
            raise ValueError(f"ranks must be below {MOST_RANKS}")
        children, ends = {}, [-1]
        for piece, rank in ranks.items():
            node = 0
            for byte in piece:
                below = children.get(node << 8 | byte)
                if below is None:
                    below = children[node << 8 | byte] = len(ends)
                    ends.append(-1)
                node = below
            ends[node] = rank
        size = 1 << max(4, (4 * len(children)).bit_length())
        keys, found = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        for key, below in children.items():
            at = cls._slot(key, size)
            while keys[at] >= 0:
                at = (at + 1) % size
            keys[at], found[at] = key, below
        pairs = [children.get(children.get(pair >> 8, -1) << 8 | pair & 255, -1) for pair in range(1 << 16)]
        return cls(keys, found, np.array(ends, np.int32), np.array(pairs, np.int32))

    @staticmethod
    def _slot(key, size: int):
        return (key * MULTIPLIER >> 8) & (size - 1)

    def below(self, nodes: np.ndarray, bytes_: np.ndarray) -> np.ndarray:
        """The child of each node by its byte, -1 without one."""
        key = nodes.astype(np.int64) << 8 | bytes_
        at = self._slot(key, len(self.keys))
        there = self.keys[at]
        out = np.where(there == key, self.children[at], -1)
        more = np.flatnonzero((there != key) & (there >= 0))
        while len(more):
            at[more] = (at[more] + 1) % len(self.keys)
            there = self.keys[at[more]]
            hit = there == key[more]
            out[more[hit]] = self.children[at[more[hit]]]
            more = more[~hit & (there >= 0)]
        return out

    def runs(self, words: list[bytes]) -> np.ndarray:
        """Runs of two bytes or more that are pieces: word, rank and run packed into a number each, in this order."""
        parts = [self._runs(words[n:n + AT_ONCE]) + n * MOST_RANKS * PLACES**2 for n in range(0, len(words), AT_ONCE)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def _runs(self, words: list[bytes]) -> np.ndarray:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words), np.uint8)
        stops = np.cumsum(sizes)
        starts = stops - sizes
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        at = np.flatnonzero(word[1:] == word[:-1])
        word, length, found = word[at], 2, []
        node = self.pairs[text[at].astype(np.int32) << 8 | text[at + 1]]
        while len(at):
            kept = node >= 0
            at, word, node = at[kept], word[kept], node[kept]
            rank = self.ranks[node]
            hit = np.flatnonzero(rank >= 0)
            i = at[hit] - starts[word[hit]]
            found.append((word[hit].astype(np.int64) * MOST_RANKS + rank[hit]) * PLACES**2 + i * PLACES + i + length)
            kept = at + length < stops[word]
            at, word, node = at[kept], word[kept], node[kept]
            node = self.below(node, text[at + length])
            length += 1
        packed = np.concatenate(found) if found else np.zeros(0, np.int64)
        packed.sort()
        return packed


def places_of(run: int) -> tuple[int, int]:
    """The bits of a run's places, and of its two ends alone."""
    i, j = divmod(run, PLACES)
    return (1 << j + 1) - (1 << i), 1 << i | 1 << j


def unruly(trie: Trie, ranks: dict[bytes, int]) -> list[int]:
    """Ranks of pieces that one pass over the runs of their own bytes does not make.

    Between two places that stay, a run of a word's bytes changes by itself. If the pass makes a piece of such a run, it does
    so at the piece's rank, so the pair that is this piece cannot come up at a higher rank.
    """
    pieces = [piece for piece in ranks if 2 <= len(piece) <= FOLD_BYTES]
    left = [(2 << len(piece)) - 1 for piece in pieces]
    for packed in trie.runs(pieces).tolist():
        n, (bits, ends) = packed // (MOST_RANKS * PLACES**2), places_of(packed % PLACES**2)
        if ((left[n] & bits) ^ ends).bit_count() == 1:
            left[n] &= ~bits | ends
    return [ranks[piece] for piece, places in zip(pieces, left, strict=True) if places.bit_count() > 2]


def place_literals() -> Column:
    """For each run the bits of its places, and of its ends, as two literal arrays."""
    # runs that end before they begin, or beyond a word, do not occur
    both = [places_of(run) if run // PLACES < run % PLACES <= FOLD_BYTES else (0, 0) for run in range(PLACES**2)]
    return F.from_json(F.lit(json.dumps({"bits": [b for b, _ in both], "ends": [e for _, e in both]})),
                       "struct<bits:array<bigint>,ends:array<bigint>>")


def merged(places: Column, runs: Column, literals: Column) -> Column:
    """The places that are left in a word after a fold over its runs, the lowest rank first.

    Two neighbours make a run if its ends are places and one place is left between; where an end is not and nothing is
    left between, there is nothing to clear. So one bit has to differ from the ends.
    """
    def step(left: Column, run: Column) -> Column:
        bits, ends = F.get(literals["bits"], run), F.get(literals["ends"], run)
        met = F.bit_count(left.bitwiseAND(bits).bitwiseXOR(ends)) == 1
        return F.when(met, left.bitwiseAND(F.bitwise_not(bits).bitwiseOR(ends))).otherwise(left)

    return F.aggregate(runs, places, step)


def merged_by_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for one long word: candidate pairs wait in a heap by rank and place."""
    ends = list(range(1, len(word) + 1))
    before, alive = list(range(-1, len(word) - 1)), [True] * len(word)
    heap: list[tuple[int, int, int]] = []

    def offer(at: int) -> None:
        if ends[at] < len(word):
            rank = ranks.get(word[at:ends[ends[at]]])
            if rank is not None:
                heapq.heappush(heap, (rank, at, ends[ends[at]]))

    for i in range(len(word) - 1):
        offer(i)
    while heap:
        _, at, end = heapq.heappop(heap)
        if not alive[at] or ends[at] >= len(word) or ends[ends[at]] != end:
            continue
        alive[ends[at]] = False
        ends[at] = end
        if end < len(word):
            before[end] = at
        offer(at)
        if before[at] >= 0:
            offer(before[at])
    found, at = [], 0
    while at < len(word):
        found.append(ranks[word[at:ends[at]]])
        at = ends[at]
    return found


def _nested(lengths, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), values)


BLOCK = "spelled binary, sizes array<int>, places array<long>, runs array<array<int>>, docs array<struct<doc_id:long,at:array<int>>>"


def _blocks(batches: Iterator[pa.RecordBatch], pattern: str, ranks: dict[bytes, int], trie: Trie, odd: list[int],
            most: int) -> Iterator[pa.RecordBatch]:
    """Blocks of documents: their distinct words with places and runs, and each document as places in that list.

    A word that has a rank has no place inside. A long or unruly word has no places at all.
    """
    split = regex.compile(pattern).findall

    def block(docs: list[int | None], counts: list[int], at: array, words: dict[str, int]) -> pa.RecordBatch:
        texts = pa.StructArray.from_arrays(
            [pa.array(docs, pa.int64()), _nested(counts, pa.array(np.frombuffer(at, np.int32)))], ["doc_id", "at"])
        spelled = [word.encode() for word in words]
        whole = np.fromiter((word in ranks for word in spelled), bool, len(spelled))
        sizes = np.fromiter(map(len, spelled), np.int64, len(spelled))
        short = np.minimum(sizes, FOLD_BYTES)
        left = np.where(sizes > FOLD_BYTES, 0, np.where(whole, 1 | 1 << short, (2 << short) - 1))
        folded = np.flatnonzero(~whole & (sizes <= FOLD_BYTES))
        packed = trie.runs([spelled[n] for n in folded])
        of = folded[packed // (MOST_RANKS * PLACES**2)]
        if odd:
            left[of[np.isin(packed // PLACES**2 % MOST_RANKS, odd)]] = 0
            packed, of = packed[left[of] > 0], of[left[of] > 0]
        runs = _nested(np.bincount(of, minlength=len(spelled)), pa.array((packed % PLACES**2).astype(np.int32)))
        lists = [pa.array(sizes, pa.int32()), pa.array(left, pa.int64()), runs, texts]
        return pa.RecordBatch.from_arrays(
            [pa.array([b"".join(spelled)], pa.binary()), *(_nested([len(values)], values) for values in lists)],
            ["spelled", "sizes", "places", "runs", "docs"])

    def begun() -> tuple[list, list, array, dict[str, int], int]:
        # a new word gets the next number
        return [], [], array("i"), defaultdict(count().__next__), 0

    docs, counts, at, words, size = begun()
    for batch in batches:
        for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            before = len(at)
            at.extend(map(words.__getitem__, split(text)))
            docs.append(doc)
            counts.append(len(at) - before)
            size += len(text)
            if size >= most:
                yield block(docs, counts, at, words)
                docs, counts, at, words, size = begun()
    if docs:
        yield block(docs, counts, at, words)


def _ids(spelled: bytes, sizes: np.ndarray, left: np.ndarray, ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words one after another, the pieces between the places that are left, and how many each word has.

    A word without places is merged here.
    """
    starts = np.cumsum(sizes) - sizes
    word, place = np.nonzero(np.unpackbits(left.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    # every word's last place begins no piece
    inner = np.flatnonzero(word[1:] == word[:-1])
    word, begin, end = word[inner], starts[word[inner]] + place[inner], starts[word[inner]] + place[inner + 1]
    pieces = map(spelled.__getitem__, map(slice, begin.tolist(), end.tolist()))
    ids, counts = np.fromiter(map(ranks.__getitem__, pieces), np.uint32, len(begin)), np.bincount(word, minlength=len(sizes))
    apart = {}
    for n in np.flatnonzero(left == 0).tolist():
        raw = spelled[starts[n]:starts[n] + sizes[n]]
        apart[n] = [ranks[raw]] if raw in ranks else merged_by_heap(raw, ranks)
    if apart:
        at = np.repeat((np.cumsum(counts) - counts)[list(apart)], [len(found) for found in apart.values()])
        ids = np.insert(ids, at, np.concatenate([*apart.values()]))
        counts[list(apart)] = [len(found) for found in apart.values()]
    return ids, counts


def _cut(text: bytes, sizes: np.ndarray) -> list[bytes]:
    """A text in pieces of these sizes."""
    ends = np.cumsum(sizes)
    return list(map(text.__getitem__, map(slice, (ends - sizes).tolist(), ends.tolist())))


RESULT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _digests(batches: Iterator[pa.RecordBatch], ranks: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """The documents of each block: ids of words are laid out as the documents have the words, and decoded by their pieces."""
    pieces: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    for batch in batches:
        for n in range(batch.num_rows):
            sizes, left, docs = (batch[name].slice(n, 1).flatten() for name in ("sizes", "left", "docs"))
            ids, counts = _ids(batch["spelled"][n].as_py(), sizes.to_numpy().astype(np.int64), left.to_numpy(), ranks)
            codes = _cut(ids.astype("<u4").tobytes(), 4 * counts)
            sums = np.concatenate([[0], np.cumsum(lengths[ids])])
            ends = np.cumsum(counts)
            texts = _cut(b"".join(map(pieces.__getitem__, ids.tolist())), sums[ends] - sums[ends - counts])
            doc_ids, lists = docs.flatten()
            stops, at = lists.offsets.to_numpy().tolist(), lists.values.to_numpy().tolist()
            rows = []
            for a, b in zip(stops, stops[1:]):
                code = b"".join(map(codes.__getitem__, at[a:b]))
                text = b"".join(map(texts.__getitem__, at[a:b]))
                rows.append((len(code) // 4, hashlib.sha256(code).hexdigest(), hashlib.sha256(text).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [doc_ids, *(pa.array(c, f.type) for c, f in zip(zip(*rows), list(RESULT)[1:]))], schema=RESULT)


def encoded(docs: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN, text_column: str = "text",
            id_column: str = "doc_id", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Each document's ids (``n_tokens`` and a digest) and a digest of the bytes that they decode to.

    Decoding puts the bytes of the ids one after another. A null or empty text has no ids. Repeated rows give
    repeated results, null ids are kept, an empty table gives no rows.
    """
    ranks = read_ranks(ranks_path)
    trie = Trie.of(ranks)
    odd = unruly(trie, ranks)
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"),
                       F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"))
    blocks = rows.mapInArrow(lambda batches: _blocks(batches, pattern, ranks, trie, odd, block_chars), BLOCK)
    left = let(place_literals(), lambda known: F.zip_with("places", "runs", lambda places, runs: merged(places, runs, known)))
    return blocks.select("spelled", "sizes", left.alias("left"), "docs").mapInArrow(
        lambda batches: _digests(batches, ranks), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
