"""Malformed markup in linear time, articles of small hosts, sections by their names."""

import time

import pytest

from sluice.llm import pages


def texts(page):
    return [b.text for b in pages.blocks_of(page) if not b.dropped]


@pytest.mark.parametrize("unit", ['<a "', "<a b='", "<!", "</", "<a", "<a b=\"'", '"<a ', "<p class='x\">", "<!--", "<script>", "</script  "])
def test_a_megabyte_of_malformed_markup_takes_no_time(unit):
    begun = time.perf_counter()
    pages.blocks_of("<article><p>own text</p>" + unit * (1_000_000 // len(unit)))
    assert time.perf_counter() - begun < 5


def test_quoted_values_and_open_quotes():
    assert texts('<article><p title="a > b" data-x=\'<b>\'>one</p><p title="open>two</p><p>three</p></article>') == ["one", "two", "three"]
    assert texts("<article><p>1 < 2 and 3 > 2</p></article>") == ["1 < 2 and 3 > 2"]


def test_reader_comments_go_and_bylines_and_related_sections_of_the_article_stay():
    page = ("<main><p class='byline'>By A. Writer</p><p>text</p><section class='related'><p>related work</p></section></main>"
            "<div class='reader-comments'><p>first!</p></div><div class='related'><p>more to read</p></div>")
    assert texts(page) == ["By A. Writer", "text", "related work"]
    assert texts("<article><p>text</p><div class='reader-comments'><p>first!</p></div></article>") == ["text"]


def test_copies_on_a_small_host_keep_heading_and_first_paragraph():
    page = "<article><h1>A heading of the article that three pages have alike</h1><p>{}</p><p>{}</p></article>"
    first = "The first sentence of this article which stands on each of the three pages."
    whole = pages.main_texts([page.format(first, f"Then comes {i} something else {i} that only {i} one page {i} has got.") for i in "abc"])
    assert all(t.startswith("A heading of the article that three pages have alike\n\n" + first) for t in whole)
    assert len(set(whole)) == 3


def test_hosts_without_counted_runs_get_the_texts_that_counting_gives(spark):
    rows, by_host = [], {}
    notice = "<p>please read the terms of this site before you use any of it today</p>"
    for n, host in enumerate(("plain", "notices", "copies", "bare", "mixed", "few")):
        for i in range(3 if host == "few" else 9):
            body = "".join(f"<p>{host} {i} paragraph {j} has words {i * 31 + j} that no other page has {i}-{j}</p>" for j in range(4))
            if host == "copies" and i % 3 == 0:
                body = "<p>one first paragraph of a text</p><p>that several pages of this host have copied word for word</p>"
            page = f"<nav>home about</nav><article><h1>title {i}</h1>{body}{notice if host == 'notices' or host == 'mixed' and i == 3 else ''}</article>"
            if host == "bare" or host == "mixed" and i % 2:
                page = f"<body><div>only {host} {i}</div>{notice}</body>"
            rows.append((100 * n + i, f"http://{host}.example/{i}", page))
            by_host.setdefault(host, []).append(rows[-1])
    wanted = {r[0]: text for pages_of in by_host.values() for r, text in zip(pages_of, pages.main_texts([r[2] for r in pages_of]), strict=True)}
    rows += [(None, None, None), (901, "http://empty.example/", "")]
    found = {r["page_id"]: r["text"] for r in pages.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {**wanted, None: "", 901: ""}
    assert all("terms" not in found[i] for i in range(100, 109)) and "terms" not in found[401]
