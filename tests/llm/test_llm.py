"""Small tables against brute force: nulls, empty texts, ties, repeated rows, clashing columns, empty tables."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from sluice.llm import bpe, exact, language, licenses, packing, pages, private, quality, sharding, similar
from sluice.llm.queries import BYTE_RANKS, ORACLES, QUERIES, WORD_TOKENIZER, ready
from sluice.llm.shared import leftovers_discarded, numbered, recorded, staged
from tests.oracle import connect, spark_rows, sql_rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _rid string"
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen"
LONG = " ".join(f"w{i}" for i in range(60))
TEXTS = [
    BASE, BASE, BASE + " ", BASE.upper(), LONG, LONG + " more", LONG.replace("w7 ", "z "), "", None, "   \n\t", "a", "é ñ ß",
    "Write to anna.smith@mail.example.org or +1 (743) 555-3824, ip 10.20.30.40.",
    "anna.smith@mail.example.org again", "Released under the MIT License.\nMIT license, mit license", "x" * 300 + " y",
    "it's   <|endoftext|> 12345 ...",
]


@pytest.fixture(scope="module")
def docs(spark):
    ready(spark)
    rows = [(i, t, "en", "s", None, "own") for i, t in enumerate(TEXTS)] + [(0, BASE, "en", "s", None, "own"), (None, "a", None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_bpe_agrees_with_tiktoken_and_round_trips(docs, nothing):
    ranks = bpe.read_ranks(BYTE_RANKS)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = by_id(bpe.encoded(docs, BYTE_RANKS, block_chars=100))
    for i, text in enumerate(TEXTS):
        ids = np.array(known.encode_ordinary(text or ""), "<u4")
        assert found[i]["n_tokens"] == len(ids)
        assert found[i]["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.encoded(nothing, BYTE_RANKS).count() == 0


def by_merging(word, ranks):
    """One word's ids, by definition: the leftmost of the lowest-ranked neighbours are joined for as long as any has a rank."""
    parts = [word[i:i + 1] for i in range(len(word))]
    while not (word in ranks or len(parts) < 2):
        best = min((ranks.get(a + b, 1 << 30), n) for n, (a, b) in enumerate(zip(parts, parts[1:])))
        if best[0] == 1 << 30:
            break
        parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return [ranks[word]] if word in ranks else [ranks[p] for p in parts]


def test_bpe_of_ranks_that_one_pass_does_not_follow(spark, tmp_path):
    """Here ``abc`` comes up at the rank of ``bc``, which is above its own; ``ef`` and ``fg`` overlap, and a word is long."""
    ready(spark)
    ranks = {bytes([b]): b for b in range(256)}
    ranks |= {piece: 256 + n for n, piece in enumerate([b"abc", b"bc", b"abcd", b"fg", b"ef", b"efgh", b"xx", b"xxxx"])}
    path = tmp_path / "ranks"
    path.write_text("".join(f"{base64.b64encode(p).decode()} {r}\n" for p, r in ranks.items()))
    assert bpe.unruly(bpe.Trie.of(ranks), ranks) == [ranks[b"abc"], ranks[b"abcd"], ranks[b"efgh"]]
    texts = ["zabcdz", "efgz fgefz", "abcdefgh", "x" * 7 + "y", "x" * 61 + "y", "x" * 62 + "y", "y" + "abc" * 40 + "x" * 100, "abc", ""]
    found = by_id(bpe.encoded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), str(path)))
    for i, text in enumerate(texts):
        ids = [n for word in regex.findall(public_tokenizers.PATTERN, text) for n in by_merging(word.encode(), ranks)]
        assert found[i]["n_tokens"] == len(ids)
        assert found[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_carries_little_to_the_fold():
    """A word reaches the fold as places and runs of two bytes or more; one that is a piece, is long or unruly has none."""
    ranks = bpe.read_ranks(BYTE_RANKS)
    text = " the zqxzqx " + "q" * 70
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1], pa.int64()), "text": [text]})
    [block] = bpe._blocks(iter([batch]), public_tokenizers.PATTERN, ranks, bpe.Trie.of(ranks), [], 100)
    row = block.to_pylist()[0]
    words = regex.findall(public_tokenizers.PATTERN, text)
    for word, size, places, runs in zip(words, row["sizes"], row["places"], row["runs"], strict=True):
        raw = word.encode()
        pieces = {(i, j): ranks.get(raw[i:j]) for i in range(size) for j in range(i + 2, size + 1)}
        known = sorted((rank, i, j) for (i, j), rank in pieces.items() if rank is not None)
        fold = raw not in ranks and size <= bpe.FOLD_BYTES
        assert runs == ([i * bpe.PLACES + j for _, i, j in known] if fold else [])
        assert places == ((2 << size) - 1 if fold else 1 | 1 << size if raw in ranks else 0)


def shingle_set(text, width):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def test_components_agree_with_all_pairs(docs, nothing):
    sets = {i: shingle_set(t, 4) for i, t in enumerate(TEXTS)}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    found = by_id(similar.linked(docs))
    assert {i: (found[i]["component_id"], found[i]["n_shingles"]) for i in sets} == {i: (root[i], len(sets[i])) for i in sets}
    assert similar.linked(docs).count() == docs.count()
    assert similar.linked(nothing).count() == 0


def test_exact_groups_keep_the_longest_then_smallest_id(docs, nothing):
    found = exact.exact_groups(numbered(docs, "t", "_own"), row_column="_own").collect()
    plain = {i: "".join((t or "").translate({ord(c): None for c in " \t\n\x0b\f\r"})) for i, t in enumerate(TEXTS)}
    for r in (x for x in found if x["doc_id"] is not None):
        same = [i for i in plain if plain[i] == plain[r["doc_id"]]]
        assert r["keep_id"] == min(same, key=lambda i: (-len(TEXTS[i] or ""), i))
        assert r["text_sha256"] == hashlib.sha256(plain[r["doc_id"]].encode()).hexdigest()
    assert sum(r["kept"] for r in found) == len(set(plain.values()))
    kept = exact.without_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(plain.values()))
    assert exact.without_copies(nothing).count() == 0


def test_license_phrases_and_templates(docs, nothing):
    found = by_id(licenses.scanned_licenses(docs))
    hit = found[14]
    assert (hit["n_words"], hit["n_base"], hit["first_word"], hit["last_word"]) == (9, 3, 3, 7)
    assert hit["base_labels"] == "mit" and "mit" in hit["labels"].split(",") and hit["score"] == 1.0
    assert found[8]["n_words"] == 0 and found[8]["first_word"] is None and found[8]["labels"] == ""
    assert licenses.scanned_licenses(nothing).count() == 0


def test_wrapped_notices_match_and_siblings_do_not(spark):
    mit = ("Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files "
           "(the \"Software\"), to deal\n#\n# in the Software without restriction, including")
    rows = ["x\n# " + mit, "GNU General Public License as published by the Free Software Foundation", "Licensed under CC BY 4.0.",
            "This work is licensed under a Creative Commons Attribution 4.0 International License",
            "GNU Lesser General Public\nLicense as published by\nthe Free Software Foundation",
            "Ich komme mit\nLicensed under the Apache License, Version 2.0."]
    found = by_id(licenses.scanned_licenses(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")))
    labels = [found[i]["labels"].split(",") for i in range(6)]
    assert labels[5] == ["apache"]
    assert labels[0] == ["mit"] and found[0]["score"] >= 0.8 and "lgpl" not in labels[1] and labels[2] == [""]
    assert labels[3] == ["cc-by"] and "lgpl" in labels[4]


def test_language_is_learned_and_text_without_letters_is_unknown(spark, nothing):
    ready(spark)
    words = {"en": "the house and the river of this land", "de": "und das schöne wetter über der straße"}
    rows = [(i, f"{words[x]} {i} {words[x]}", x) for i in range(120) for x in ("en", "de")] + [(900, "123 456", "en"), (901, None, "de")]
    docs = spark.createDataFrame([(2 * i if x == "en" else 2 * i + 1, t, x) if i < 900 else (i, t, x) for i, t, x in rows],
                                 "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in language.identified(docs).join(docs, "doc_id").collect()}
    held = [r for r in found.values() if r["held_out"] and r["doc_id"] < 900]
    assert held and sum(r["lang_pred"] == r["lang"] for r in held) / len(held) >= 0.95
    assert {found[900]["lang_pred"], found[901]["lang_pred"]} == {"und"}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found.values())
    assert language.identified(nothing).count() == 0


@pytest.mark.parametrize("text", [
    "a <|endoftext|> b", "<|endoftext|>", "x<|startoftext|>y", "<|ENDOFTEXT|> Big", "<|EndOfText|><|endoftext|>", "<|endoftext| >", "Ünï  İ<|endoftext|>é\n\t", "it's WE'LL 12345 ...", "",
    "ſ K Å ǅ ẞ " * 3])
def test_ids_are_those_of_the_plain_tokenizer(text):
    plain = Tokenizer.from_file(WORD_TOKENIZER)
    assert packing.token_ids(packing.Words(WORD_TOKENIZER), text).tolist() == [*plain.encode(text, add_special_tokens=False).ids, 1]


def test_packing_places_every_token_once(docs, nothing):
    words = packing.Words(WORD_TOKENIZER)
    found = packing.packed(docs, WORD_TOKENIZER, length=64).collect()
    for i, text in enumerate(TEXTS[1:], 1):
        ids = np.array(words.tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        mine = sorted((r for r in found if r["doc_id"] == i), key=lambda r: r["start"])
        assert sum(r["length"] for r in mine) == len(ids) == mine[0]["doc_tokens"]
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes()) for r in mine)
    filled = {}
    for r in sorted(found, key=lambda r: r["offset"]):
        assert filled.get(r["sequence_id"], 0) == r["offset"]
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 64
    assert packing.packed(nothing, WORD_TOKENIZER).count() == 0


def test_first_fit_decreasing_agrees_with_a_plain_search():
    lengths = [int(x) for x in np.random.default_rng(1).integers(1, 100, 300)]
    room, plain = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = next((b for b, r in enumerate(room) if r >= lengths[i]), len(room))
        room += [100] * (at == len(room))
        room[at] -= lengths[i]
        plain[i] = at
    assert packing.first_fit_decreasing(lengths, 100) == [plain[i] for i in range(len(lengths))]


def test_surrogates_are_consistent_distinct_and_of_the_same_kind(docs, nothing):
    changed = private.replaced(docs, "k", count_column="n")
    found = by_id(changed)
    first, second = found[12]["text"], found[13]["text"]
    assert found[12]["n"] == 3 and found[13]["n"] == 1
    assert "anna" not in first and "555-3824" not in first and "10.20.30.40" not in first
    assert second.split()[0] in first and second.split()[0].count("@") == 1
    assert all(found[i]["text"] == TEXTS[i] for i in (1, 8, 15, 16)) and "own" in {r["_rid"] for r in changed.collect()}
    assert private.replaced(nothing, "k").count() == 0


def test_cards_have_check_digits_and_secrets_both_cases(spark):
    def luhn(number):
        digits = [int(c) for c in reversed(number) if c.isdigit()]
        return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    cards = ["4111 1111 1111 1111", "378282246310005", "3782-822463-10005", "30569309025904", "4222222222222", "6304000000000000000", "2223003122003222"]
    plain = ["4111111111111112", "6625883203433323", "378282246310006"]
    rows = [(i, c) for i, c in enumerate([*cards, *plain, "TOKEN = " + "9233A8EC" * 5, "4111 1111 1111 1111 123"])]
    found = {r["doc_id"]: r for r in private.replaced(spark.createDataFrame(rows, "doc_id long, text string"), "k", count_column="n").collect()}
    for i, card in enumerate(cards):
        new = found[i]["text"]
        assert luhn(card) and new != card and luhn(new) and len(new) == len(card) and found[i]["n"] == 1
    assert all(found[len(cards) + i]["text"] == p and found[len(cards) + i]["n"] == 0 for i, p in enumerate(plain))
    assert "9233A8EC" not in found[10]["text"] and found[10]["n"] == 1
    assert found[11]["text"] == found[0]["text"] + " 123"


def test_shards_are_minimal_and_slots_gapless(docs, nothing):
    rows = sharding.sharded(docs, 3).collect()
    groups, size = {}, {}
    for r in rows:
        groups.setdefault(r["shard"], []).append(r["slot"])
        size[r["shard"]] = size.get(r["shard"], 0) + r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in groups.values())
    order = {}
    for t in [*TEXTS, BASE, "a"]:
        key = hashlib.sha256((t or "").encode()).hexdigest()
        order[key] = order.get(key, 0) + len((t or "").encode()) + 1
    sizes = [order[k] for k in sorted(order)]
    best = min(max(sum(sizes[:i]), sum(sizes[i:j]), sum(sizes[j:])) for i in range(len(sizes) + 1) for j in range(i, len(sizes) + 1))
    assert max(size.values()) == best
    assert sharding.sharded(nothing).count() == 0


def test_quality_counts_agree_with_plain_python(spark, docs, nothing):
    repeated = "\n".join(["a b c d e f g h i j"] * 3 + ["# k"])
    more = docs.select("doc_id", "text").unionAll(spark.createDataFrame([(50, repeated)], "doc_id long, text string"))
    found = by_id(quality.judged(more))
    for i, text in [*enumerate(TEXTS), (50, repeated)]:
        words = (text or "").encode().split()
        windows = [tuple(words[j:j + 8]) for j in range(len(words) - 7)]
        covered = {j + k for j, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
        lines = [x for x in (text or "").split("\n") if x.encode().split()]
        r = found[i]
        assert (r["n_words"], r["n_repeat_words"], r["n_dup_lines"]) == (len(words), len(covered), len(lines) - len(set(lines)))
        assert r["word_chars"] == sum(len(w.decode()) for w in words)
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in text or "")
        assert r["base_failed"] == (len(words) < 20 or 100 * len(covered) > 30 * len(words))
    assert quality.judged(nothing).count() == 0


def test_main_text_leaves_out_boilerplate(spark):
    page = ('<html><head><title>t</title></head><body><nav><li>menu</li></nav><article><h1>Head &amp; line</h1><p>First<br>\n para'
            '<p>Second<div class="comments">no</div></article><footer>&copy; foot</footer><script>var a="</p>"</script>')
    bare = "<body><div>{}</div><div>all rights are reserved by the owner of this very site</div></body>"
    assert pages.main_texts([bare.format("alpha"), bare.format("beta")]) == ["alpha", "beta"]
    rows = [(1, "http://a.example/1", page), (2, "http://a.example/2", None), (3, None, ""), (3, None, "")]
    found = {r["page_id"]: r["text"] for r in pages.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {1: "Head & line\n\nFirst para\n\nSecond", 2: "", 3: ""}


def test_repeated_runs_agree_with_a_plain_search():
    random = np.random.default_rng(3)
    streams = [random.integers(0, 3, 40) for _ in range(4)]
    runs = [{tuple(s[i:i + 5]) for i in range(36)} for s in streams]
    for k, (s, got) in enumerate(zip(streams, pages.repeated(streams, 5), strict=True)):
        want = np.zeros(40, bool)
        for i in range(36):
            if any(tuple(s[i:i + 5]) in r for j, r in enumerate(runs) if j != k):
                want[i:i + 5] = True
        assert (got == want).all()


def test_boilerplate_goes_wherever_the_host_has_it_again(spark):
    notice = "<div>all rights are reserved by the owner of this very site</div>"
    rows = [(i, f"http://big.example/{i}", f"<body><div>only {i}</div>{notice if i in (3, 250) else ''}</body>") for i in range(300)]
    rows += [(1000, "http://b.example/", f"<body><div>other host</div>{notice}</body>")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in pages.extracted(table).collect()}
    assert len(found) == 301 and all(found[i] == f"only {i}" for i in range(300))
    assert found[1000].startswith("other host\n\nall rights")


def test_boilerplate_inside_articles_goes_and_copied_articles_stay():
    share = "<p>Share this story with all of your friends and please subscribe today</p>"
    def body(name):
        return "".join(f"<p>{' '.join(f'{name}{k}x{i}' for i in range(12))}</p>" for k in range(3))
    own = [f"<article>{body(n)}{share}</article>" for n in "abcdefgh"]
    # three copies, one of them with a changed word
    own += [own[0], own[0].replace("a1x5", "other")]
    for n, text in zip("abcdefghaa", pages.main_texts(own), strict=True):
        assert "Share" not in text and text.count("\n\n") == 2 and text.startswith(f"{n}0x0 ") and text.endswith(f"{n}2x11")
    # a sentence that articles have at different places is their own text
    quote = "<p>to be or not to be that is the question</p>"
    moving = [f"<article>{''.join(f'<p>{n}{k} text</p>' for k in range(i))}{quote}{'<p>end</p>' * (9 - i)}</article>" for i, n in enumerate("abcdefgh")]
    assert all("to be or not" in text for text in pages.main_texts(moving))


def test_marks_are_whole_names_and_never_drop_the_article():
    def text(page):
        return pages.main_texts([page])[0]
    for around in ('<div class="layout has-sidebar">', '<div class="sidebar">', '<div data-id="search">', "<div title='a class=ad'>"):
        assert text(f'{around}<article class="post comments-open"><p>story</p></article></div>') == "story"
    assert text('<article class="comments"><header class="entry-header"><h1>Head</h1></header><p class="alert-note">a</p>'
                '<section id="related-work">b</section><div class="share-buttons">x</div><p class="ad">y</p></article>') == "Head\n\na\n\nb"
    assert text('<main><p>story</p></main><div class="comments"><article><p>reply</p></article></div>') == "story"
    assert text('<nav><article>menu</article></nav><div class="site-footer">f</div><p>story</p>') == "story"


def test_pipeline_runs_and_keeps_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = numbered(stage(spark, docs, sf_dir), "t", "_own").drop("_own")
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).select("doc_id").distinct().count() == docs.count()


def test_exact_copies_agree_with_sql(spark):
    folder = "/root/testdata/sf0.001"
    found = spark_rows(QUERIES["op3_exact_dedup"](spark, folder))
    assert found == sql_rows(connect(folder), ORACLES["op3_exact_dedup"])


def test_working_tables_go_unless_they_are_read(spark):
    with recorded() as folders:
        first, second = staged(spark.range(3).toDF("doc_id"), "a"), staged(spark.range(5).toDF("doc_id"), "b")
    staged(spark.range(2).toDF("doc_id"), "c")
    assert len(folders) == 2
    assert leftovers_discarded(spark, folders, second.where("doc_id > 1")) == folders[1:]
    assert second.count() == 5
    with pytest.raises(Exception, match="does not exist|FAILED_READ_FILE|PATH_NOT_FOUND"):
        first.collect()
