"""Repeated byte strings against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from sluice.llm import repeats
from sluice.llm.queries import op12_repeated_passages, ready
from sluice.llm.shared import staged

SCHEMA = "doc_id long, text string, rid string, spans string"


def brute(texts, width, keep):
    """Removed spans per text, in the order of the texts."""
    seen = {}
    for t, data in enumerate(texts):
        for i in range(len(data) - width + 1):
            seen.setdefault(data[i:i + width], []).append((t, i))
    out = [[] for _ in texts]
    for places in seen.values():
        for t, i in places if keep == "none" and len(places) > 1 else places[1:]:
            out[t].append(i)
    spans = []
    for starts in out:
        own = []
        for i in sorted(starts):
            if own and i <= own[-1][1]:
                own[-1][1] = i + width
            else:
                own.append([i, i + width])
        spans.append(own)
    return spans


def words(rng, n):
    return "".join(rng.choice("ab é") for _ in range(n))


def mixed_texts():
    rng = random.Random(4)
    shared = [words(rng, 70) for _ in range(4)]
    texts = [None, "", "short", "a" * 300, "a" * 25, "ab" * 100, shared[0], shared[0]]
    for i in range(40):
        parts = [words(rng, rng.randrange(0, 60)) for _ in range(3)]
        texts.append(parts[0] + rng.choice(shared) + parts[1] + rng.choice(shared)[:rng.randrange(10, 70)] + parts[2])
    texts += [texts[10], texts[11] + "x", "x" + texts[12], texts[13].replace("é", "a", 1)]
    return texts


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("hot", [2, 1 << 12])
def test_spans_agree_with_brute_force(spark, keep, hot):
    ready(spark)
    texts = mixed_texts()
    data = [(t or "").encode() for t in texts]
    df = spark.createDataFrame([(i, t, "own", "own") for i, t in enumerate(texts)], SCHEMA).coalesce(1)
    rows = repeats.repeats_removed(df, width=24, gram=9, keep=keep, hot=hot).collect()
    want = brute(data, 24, keep)
    assert {r["doc_id"]: r["spans"] for r in rows} == dict(enumerate(want))
    for r in rows:
        d, s = data[r["doc_id"]], want[r["doc_id"]]
        edges = [0, *(e for x in s for e in x), len(d)]
        assert bytes(r["kept"]) == b"".join(d[a:b] for a, b in zip(edges[::2], edges[1::2])) and r["n_bytes"] == len(d)


@pytest.mark.parametrize("segment", [40, 97, 1 << 21])
def test_anchors_cover_every_start_once(monkeypatch, segment):
    monkeypatch.setattr(repeats, "SEGMENT", segment)
    data = [(t or "").encode() for t in mixed_texts()]
    got = {}
    for pieces in repeats._pieces(pa.array(data, pa.binary()), 24):
        a = repeats.anchored(pieces, 24, 9)
        for row, start, n, times, off, key in zip(a["row"], a["start"], a["starts"], a["times"], a["off"], a["key"]):
            for i in range(n * times):
                assert (row, start + i) not in got
                got[row, start + i] = (data[row][start + i:start + i + 24], int(key), int(off) - i % n)
    assert set(got) == {(r, i) for r, d in enumerate(data) for i in range(len(d) - 23)}
    by_string = {}
    for string, *anchor in got.values():
        assert by_string.setdefault(string, anchor) == anchor


def test_previous_smaller_and_factors():
    rng = np.random.default_rng(0)
    for values in (np.arange(50), np.arange(50)[::-1].copy(), rng.permutation(200)):
        want = [max((j for j in range(i) if values[j] < values[i]), default=-1) for i in range(len(values))]
        assert repeats.previous_smaller(values).tolist() == want
    ranks = rng.integers(0, 5, 60)
    later, source = repeats.previous_factors(ranks)
    assert later.tolist() == [r in ranks[:i] for i, r in enumerate(ranks)]
    assert (later | source).tolist() == [(ranks == r).sum() > 1 for r in ranks]


def test_ranks_order_strings():
    data = np.frombuffer("".join(words(random.Random(5), 300)).encode(), np.uint8)
    at = np.arange(len(data) - 23)
    ranks = repeats.suffix_ranks(data, 24)(at)
    strings = [bytes(data[i:i + 24]) for i in at]
    order = sorted(set(strings))
    by_rank = {s: r for s, r in zip(strings, ranks)}
    assert [by_rank[s] for s in order] == sorted(set(ranks.tolist()))


def test_query_on_the_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    data = [(r["text"] or "").encode() for r in docs]
    want = brute(data, 400, "none")
    got = {r["doc_id"]: r for r in op12_repeated_passages(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for r, d, s in zip(docs, data, want):
        edges = [0, *(e for x in s for e in x), len(d)]
        kept = b"".join(d[a:b] for a, b in zip(edges[::2], edges[1::2]))
        own = got[r["doc_id"]]
        assert (own["n_bytes"], own["n_removed"], own["n_spans"]) == (len(d), len(d) - len(kept), len(s))
        assert own["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_empty_table_repeated_rows_and_null_ids(spark):
    ready(spark)
    assert repeats.repeats_removed(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(None, "b" * 20 + "c" * 20, None, None)] * 3, SCHEMA)
    assert {len(r["kept"]) for r in repeats.repeats_removed(df, width=16, gram=8, keep="none").collect()} == {0}
    first = staged(df.limit(1), "t")
    assert [r["spans"] for r in repeats.repeats_removed(first, width=16, gram=8, keep="none").collect()] == [brute([b"b" * 20 + b"c" * 20], 16, "none")[0]]
    with pytest.raises(ValueError):
        repeats.repeats_removed(df, keep="last")
    with pytest.raises(ValueError):
        repeats.repeats_removed(df, width=4, gram=2)
