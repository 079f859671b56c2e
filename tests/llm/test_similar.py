"""Groups of near copies against all pairs: stars of copies that are not linked with each other, chains, common passages."""

import random

import pytest

from sluice.llm import similar
from sluice.llm.queries import ready


def made(seed):
    """Families of copies with a few words changed, a passage that many share, a chain of sliding windows, long and short texts."""
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    passage = draw.choices(words, k=25)
    texts = []
    for size in (30, 80, 400):
        base = draw.choices(words, k=size)
        texts.append(base)
        for _ in range(25):
            copy = list(base)
            for _ in range(draw.randint(1, max(1, size // 40))):
                copy[draw.randrange(size)] = draw.choice(words)
            texts.append(copy)
    texts += [draw.choices(words, k=draw.randint(1, 20)) + passage + draw.choices(words, k=draw.randint(1, 6)) for _ in range(60)]
    chain = draw.choices(words, k=160)
    texts += [chain[i:i + 100] for i in range(0, 60, 3)]
    texts += [["w1"], ["w1", "w2", "w3"], [], draw.choices(words, k=20000)]
    texts.append(texts[-1][:17500])
    draw.shuffle(texts)
    return [" ".join(t) for t in texts] + [None, "W1  w2\tw3"]


def expected(texts, width, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, x in enumerate(sets):
        for b in range(a):
            both = len(x & sets[b])
            if both and 100 * both >= percent * (len(x) + len(sets[b]) - both):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("paying", [similar.PAYING, 0])
def test_groups_agree_with_all_pairs_by_pivots_and_pair_by_pair(spark, monkeypatch, paying):
    monkeypatch.setattr(similar, "PAYING", paying)
    texts = made(5)
    docs = ready(spark).createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar.linked(docs).collect()}
    assert found == expected(texts, similar.WORDS, similar.PERCENT)


def test_lists_with_the_same_members_are_one(spark):
    nodes = spark.createDataFrame([(0, 10, [7, 8, 9]), (1, 10, [7, 8, 9]), (2, 10, [9, 5])], "nid long, n long, first array<long>")
    lists = similar.index_lists(nodes).collect()
    assert sorted((r["token"], r["nid"], r["at"]) for r in lists) == [(7, 0, 0), (7, 1, 0), (9, 0, 2), (9, 1, 2), (9, 2, 0)]


def test_blocks_hold_every_size_that_can_be_linked(spark):
    percent = 85
    entries = spark.createDataFrame([(n, at) for n in (1, 2, 7, 20, 100, 173) for at in range(similar.prefix_length(n, percent))], "n int, at int")
    reach = {}
    for r in similar.blocks_in_reach(entries, percent).collect():
        reach.setdefault((r["n"], r["at"]), set()).add(r["block"])
    sizes = {r["n"]: r["b"] for r in spark.range(1, 260).selectExpr("cast(id as int) n").withColumn(
        "b", similar.size_block(similar.F.col("n"), percent)).collect()}
    for (n, at) in [(r["n"], r["at"]) for r in entries.collect()]:
        for m in sizes:
            follow = min(n - at, m)
            if 100 * min(n, m) >= percent * max(n, m) and (100 + percent) * follow >= percent * (n + m):
                assert sizes[m] in reach[n, at]


def test_a_ball_of_copies_that_are_not_all_linked_forms_few_pairs(spark, monkeypatch):
    """Copies with one or two passages changed are linked with their middle, but hardly with each other."""
    draw, formed = random.Random(3), []
    base = [f"b{i}" for i in range(150)]
    texts = [" ".join(base)]
    for n in range(240):
        copy = list(base)
        for place in draw.sample(range(0, 150, 6), 1 + n % 2):
            copy[place] = f"c{n}x{place}"
        texts.append(" ".join(copy))
    staged = similar.staged

    def counted(df, label):
        made = staged(df, label)
        if label == "formed":
            formed.append(made.count())
        return made

    monkeypatch.setattr(similar, "staged", counted)
    docs = ready(spark).createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar.linked(docs).collect()}
    assert found == expected(texts, similar.WORDS, similar.PERCENT)
    assert sum(formed) < 4 * len(texts), formed


def staged_counts(monkeypatch, label):
    """The rows of each table staged under the label from now on."""
    counts, staged = [], similar.staged

    def counted(df, name):
        made = staged(df, name)
        if name == label:
            counts.append(made.count())
        return made

    monkeypatch.setattr(similar, "staged", counted)
    return counts


def test_counts_by_part_bound_the_overlap_of_sets_of_all_sizes():
    draw = similar.np.random.default_rng(1)
    for n, m, both in ((0, 3, 0), (5, 5, 5), (2048, 2049, 1500), (2000, 2400, 1900), (9000, 40, 40), (40000, 33000, 30000)):
        numbers = draw.integers(0, 1 << 63, n + m - both).astype(similar.np.uint64)
        x, y = numbers[:n], numbers[n - both:]
        assert both <= similar.most_shared(similar.part_counts(x), n, similar.part_counts(y), m) <= min(n, m)
    one = similar.np.arange(1, 1000, dtype=similar.np.uint64) << similar.np.uint64(20)
    assert similar.most_shared(similar.part_counts(one), 999, similar.part_counts(one[9:]), 990) == 990


def test_texts_of_long_sets_that_share_a_line_only_are_not_compared(spark, monkeypatch):
    """They share an index list, as their own words come more often, and counts in few parts are too alike to tell such sets apart."""
    texts = [" ".join([f"d{n}w{i}" for i in range(9000)] * 4 + [f"line{n // 2}w{i}" for i in range(40)]) for n in range(4)]
    pairs = staged_counts(monkeypatch, "pairs")
    docs = ready(spark).createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar.linked(docs).collect()}
    assert found == expected(texts, similar.WORDS, similar.PERCENT)
    assert pairs and sum(pairs) == 0, pairs


def test_rounds_of_pairs_change_no_group(spark, monkeypatch):
    monkeypatch.setattr(similar, "ROUND_SHINGLES", 0.4)
    monkeypatch.setattr(similar, "ROUND_BYTES", 0.3)
    base = [f"b{i}" for i in range(150)]
    texts = [" ".join(base)] + [" ".join(base[:n] + [f"c{n}"] + base[n + 1:]) for n in range(0, 150, 4)]
    rounds, looks = staged_counts(monkeypatch, "answers"), []
    monkeypatch.setattr(similar, "plausible", lambda *x, of=similar.plausible: looks.append(1) or of(*x))
    docs = ready(spark).createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar.linked(docs).collect()}
    assert found == expected(texts, similar.WORDS, similar.PERCENT)
    assert len(rounds) >= 3 and len(looks) >= 3 and sum(rounds) >= 30, (rounds, looks)
