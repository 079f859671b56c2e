"""Main text of web pages, with boilerplate found by a suffix array over the pages of a host.

Pages are parsed once into blocks. Hosts on which no run could change a text (all pages have an article, no
block of one stands at its place on enough of them) need no runs. Pages of all others are range-partitioned by
host and read in order, up to ``CHUNK`` pages of a host at a time, so a host
of any size is spread over tasks and memory stays bounded. The token streams of a chunk are concatenated
and their suffixes sorted by prefix doubling, to the depth that a repeated run must have. The runs of all
chunks, as 64-bit hashes with their numbers of pages, meet by host and hash; every run that stands on two
distinct pages of the host is boilerplate, whatever chunks they are in, and a block mostly covered by such
runs goes.

Blocks in menus, footers, adverts and the like go even when they are unique. Inside an article element a
block goes when it stands on most of the host's pages, more than ``OFTEN`` times as many as the article's own
text does, and mostly at the same place from the article's start or end: a notice beside otherwise different
texts goes; a copied article and a line that some articles share stay.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from sluice.llm.shared import staged

CHUNK = 64
# A chunk also ends when its pages have this many characters of markup together.
CHUNK_CHARS = 1 << 23
# Tokens in a row that must repeat, and the part of a block that repeats must cover.
DEPTH = 8
COVERED = 0.5
# In an article, the part of its tokens that counts as its own text at least, and how many times more pages a block must
# stand on than that text does to be boilerplate.
OWN = 0.25
OFTEN = 2
# The part of those pages that must have the block at the same place of the article.
PLACED = 0.5
# The part of the host's pages with an article that must have the block.
MOST = 0.5
# Pages that a block may stand on in any case: copies of a few articles look like boilerplate on a small host.
FEW = 4
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

# fixed values: element names of the HTML standard
BLOCKS = frozenset((
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul"
).split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset(
    "aside button dialog fieldset footer form head iframe menu nav noscript object select svg template textarea title".split())
ARTICLE = frozenset(("article", "main"))

# class, id and role names that mark what is not the article
MARKS = frozenset((
    "ad ads advert advertisement alert banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies "
    "disqus footer header masthead menu modal nav navbar navigation newsletter notice pagination popup promo related "
    "replies reply search share sharing sidebar signup social sponsor sponsored subscribe widget"
).split())
# words that may stand beside them in a name: cookie-banner, share-buttons, site-footer, but not has-sidebar or comments-open
BESIDE = frozenset((
    "area articles bar block bottom box button buttons container content form global icons inner item items left links list main outer page "
    "panel posts primary reader readers right secondary section site slot top unit user users visitor wrap wrapper"
).split())

_RAW = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea|noscript|iframe|template|svg)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
# Quoted values may hold anything; where the quotes of a tag do not close before the next "<", it ends at its first ">".
# Nothing is tried twice, and only quoted values and what is dropped to the page's end cross a "<", so malformed pages take linear time.
_PART = re.compile(
    r"""<(/?)([A-Za-z][^\s/<>]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+(?=>)|[^<>]*+)>|<[!?/][^>]*+(?:>|\Z)|<[A-Za-z][^<>]*+\Z|([^<]++|<)""")
# whole attributes, so that nothing in another attribute's value counts as a name
_ATTRIBUTE = re.compile(r"""(?:(?<=\s)|(?<=["'])|^)([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_SPACE = re.compile(r"\s+")


class Block(NamedTuple):
    text: str
    tag: str
    dropped: bool
    article: bool
    # the article stands in an element with a mark, or has one
    doubtful: bool = False


def _marked(attributes: str, inside: bool = False) -> bool:
    """Whether a whole name marks the element; inside an article a header, or a section on related matters, is the article's own."""
    for found in _ATTRIBUTE.finditer(attributes):
        if found[1].lower() not in ("class", "id", "role"):
            continue
        for name in (found[2] or found[3] or found[4] or "").lower().split():
            words = set(re.split(r"[_-]+", name)) - {""}
            marks = words & MARKS - ({"header", "masthead", "related"} if inside else set())
            if marks and words <= MARKS | BESIDE:
                return True
    return False


def blocks_of(page: str) -> list[Block]:
    """Blocks of visible text in page order, with what the markup says about them."""
    found: list[Block] = []
    # name, dropped, in an article, dropped or doubtful because of a mark outside an article
    stack: list[tuple[str, bool, bool, bool]] = []
    text: list[str] = []
    tag, dropped, article, doubtful = "body", False, False, False

    def close() -> None:
        if text:
            joined = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if joined:
                found.append(Block(joined, tag, dropped, article, article and doubtful))
            text.clear()

    for part in _PART.finditer(_RAW.sub("", page)):
        end, name, attributes, words = part.groups()
        if words is not None:
            text.append(words)
            continue
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            text.append(" ")
            continue
        if name not in BLOCKS and name not in DROPPED and not (attributes and _marked(attributes)):
            if not end or not stack or all(name != s[0] for s in stack):
                continue
        if end:
            if all(name != s[0] for s in stack):
                if name in BLOCKS:
                    close()
                continue
            close()
            while stack.pop()[0] != name:
                pass
        else:
            close()
            if name == "p" or name == "li":
                # an open paragraph or item ends where the next one begins
                if stack and stack[-1][0] == name:
                    stack.pop()
            if name in VOID or attributes.endswith("/") and name not in BLOCKS:
                continue
            _, out, inside, mark = stack[-1] if stack else ("", False, False, False)
            hard = out and not mark or name in DROPPED or (name == "header" and not inside)
            own = bool(attributes) and name not in ("html", "body") and _marked(attributes, inside)
            main = inside or (not hard and (name in ARTICLE or 'role="main"' in attributes))
            if main and not inside:
                # a mark on the article or around it does not drop it
                out, mark = False, mark or own
            elif inside:
                out = out or hard or own
            else:
                out, mark = out or hard or own, not hard and (mark or own)
            stack.append((name, out, main, mark))
        tag, dropped, article, doubtful = stack[-1] if stack else ("body", False, False, False)
    close()
    if any(b.article and not b.dropped and not b.doubtful for b in found):
        # beside a page's article, what looks like one in a sidebar or among comments is none
        found = [b._replace(dropped=b.dropped or b.doubtful) for b in found]
    return found


def runs(streams: list[np.ndarray], depth: int = DEPTH) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Each page's runs of ``depth`` tokens by number, and for each number a place it stands at and its pages.

    Suffixes of the concatenated streams are ranked by their first 1, 2, 4, ... ``depth`` tokens; each page
    ends in a token of its own, so that no run crosses pages. Places count in the streams put end to end.
    """
    lengths = np.array([len(s) for s in streams])
    tokens = np.unique(np.concatenate(streams), return_inverse=True)[1].astype(np.int64) if lengths.sum() else np.zeros(0, np.int64)
    cuts = np.cumsum(lengths)
    rank = np.insert(tokens, cuts, len(tokens) + np.arange(len(streams)))
    n, width = len(rank), 1
    while width < depth:
        step = min(width, depth - width)
        after = np.full(n, -1, np.int64)
        after[:max(n - step, 0)] = rank[step:]
        rank = np.unique(rank * (n + 2) + after + 1, return_inverse=True)[1].astype(np.int64)
        width += step
    page = np.repeat(np.arange(len(streams)), lengths + 1)
    whole = np.arange(n) + depth <= np.repeat(cuts + np.arange(len(streams)), lengths + 1)
    # neighbours in the suffix array that agree to the depth, a page counted once
    suffixes = np.flatnonzero(whole)[np.lexsort((page[whole], rank[whole]))]
    ordered, owner = rank[suffixes], page[suffixes]
    fresh = np.append(True, ordered[1:] != ordered[:-1])[:len(ordered)]
    other = fresh | np.append(True, owner[1:] != owner[:-1])[:len(ordered)]
    number = np.zeros(n, np.int64)
    number[suffixes] = np.cumsum(fresh) - 1
    first = np.flatnonzero(fresh)
    counts = np.add.reduceat(other.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    places = suffixes[first] - page[suffixes[first]]
    return np.split(number[whole], np.cumsum(np.maximum(lengths - depth + 1, 0))[:-1]), places, counts


def spread(values: np.ndarray, length: int, depth: int = DEPTH) -> np.ndarray:
    """For each of ``length`` tokens the largest value of the runs it lies in, 1 at least."""
    most = np.ones(length, np.int64)
    for j in range(depth if len(values) else 0):
        np.maximum(most[j:j + len(values)], values, out=most[j:j + len(values)])
    return most


def repeated(streams: list[np.ndarray], depth: int = DEPTH) -> list[np.ndarray]:
    """For each page's token stream, which tokens lie in a run of ``depth`` tokens that another page has too."""
    numbers, _, counts = runs(streams, depth)
    return [spread(counts[k], len(s), depth) > 1 for k, s in zip(numbers, streams, strict=True)]


def tokens_of(blocks: list[Block]) -> tuple[np.ndarray, list[int]]:
    """64-bit hashes of a page's tokens, the same in every process, and the number of tokens of each block."""
    words = [["<" + b.tag, *b.text.split(" ")] for b in blocks]
    return pd.util.hash_array(np.array([w for block in words for w in block], object), categorize=False), [len(w) for w in words]


def _mixed(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    keys = (keys ^ values) * np.uint64(0x9E3779B97F4A7C15)
    return keys ^ keys >> np.uint64(29)


@lru_cache(4096)
def _host_hash(host: str) -> np.uint64:
    return pd.util.hash_array(np.array([host], object), categorize=False)[0]


def run_keys(tokens: np.ndarray, host: str, depth: int = DEPTH) -> np.ndarray:
    """64-bit hashes of the runs that start at each token, with the host."""
    n = max(len(tokens) - depth + 1, 0)
    keys = np.full(n, _host_hash(host), np.uint64)
    for j in range(depth if n else 0):
        keys = _mixed(keys, tokens[j:j + n])
    return keys


def place_keys(blocks: list[Block], counts: list[int], tokens: np.ndarray, host: str) -> np.ndarray:
    """For each block of an article two 64-bit hashes: of a run in it with its place from the start, and from the end."""
    inside = article_blocks(blocks)
    starts = np.cumsum(counts) - counts
    keys = np.zeros((len(blocks), 2), np.uint64)
    if inside:
        every = run_keys(tokens, host)
        # blocks that differ in a few words mostly have the same smallest run
        least = np.array([
            (every[starts[i]:starts[i] + counts[i] - DEPTH + 1] if counts[i] >= DEPTH
             else run_keys(tokens[starts[i]:starts[i] + counts[i]], host, counts[i])).min() for i in inside], np.uint64)
        at = np.arange(len(inside))
        run = _mixed(np.full(len(inside), _host_hash(host), np.uint64), least)
        for side, place in enumerate((2 * at, 2 * (len(inside) - at) + 1)):
            keys[inside, side] = _mixed(run, place.astype(np.uint64))
    return keys


def article_blocks(blocks: list[Block]) -> list[int]:
    return [i for i, b in enumerate(blocks) if b.article and not b.dropped]


def own_blocks(blocks: list[Block]) -> set[int]:
    """An article's first block and its headings, which always stay."""
    inside = article_blocks(blocks)
    return {*inside[:1], *(i for i in inside if blocks[i].tag in HEADINGS)}


def has_article(blocks: list[Block]) -> bool:
    return bool(article_blocks(blocks))


def host_key(host: str) -> np.uint64:
    """The key under which a host's pages with an article are counted."""
    return run_keys(np.zeros(1, np.uint64), host, 1)[0]


def main_text(blocks: list[Block], counts: list[int], stands: np.ndarray, placed: np.ndarray, pages: int) -> str:
    """The main text of a page, from the number of the host's pages that each token's run and each block's places stand on.

    ``pages`` is the number of the host's pages with an article. An article's headings and its first block always stay.
    """
    cuts = np.cumsum(counts)[:-1]
    each = np.split(stands, cuts)
    articles = article_blocks(blocks)
    if articles:
        # pages that the article itself stands on: most of a copied article's tokens stand on as many as there are copies
        own = np.quantile(np.concatenate([each[i] for i in articles]), OWN, method="lower")
        often = {i: np.median(each[i]) for i in articles}
        always = own_blocks(blocks)
        kept = [i for i in articles if i in always or often[i] <= max(OFTEN * own, MOST * pages, FEW)
                or placed[i].max() < PLACED * often[i]]
        return "\n\n".join(blocks[i].text for i in kept or articles)
    plain = [i for i, b in enumerate(blocks) if not b.dropped]
    kept = [i for i in plain if (each[i] > 1).mean() < COVERED]
    # a page without an article whose every block repeats is a copy, not boilerplate
    return "\n\n".join(blocks[i].text for i in kept or plain)


def main_texts(pages: list[str]) -> list[str]:
    """The main text of each page of a host."""
    parsed = [blocks_of(p) for p in pages]
    streams = [tokens_of(b) for b in parsed]
    numbers, _, pages_of = runs([tokens for tokens, _ in streams])
    places = [place_keys(b, sizes, tokens, "") for b, (tokens, sizes) in zip(parsed, streams, strict=True)]
    keys, totals = np.unique(np.concatenate(places), return_counts=True)
    return [main_text(blocks, sizes, spread(pages_of[k], len(tokens)), totals[np.searchsorted(keys, p)], sum(map(has_article, parsed)))
            for blocks, (tokens, sizes), k, p in zip(parsed, streams, numbers, places, strict=True)]


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each page's blocks, and the place keys of its article's blocks: those that may go, and those that stay."""
    page = 0
    for batch in batches:
        for start in range(0, len(batch), CHUNK):
            part = batch.iloc[start:start + CHUNK]
            parsed = [blocks_of(p) for p in part["html"]]
            loose, fixed = [], []
            for host, blocks in zip(part["host"], parsed, strict=True):
                tokens, sizes = tokens_of(blocks)
                keys, stay = place_keys(blocks, sizes, tokens, host).view(np.int64), own_blocks(blocks)
                loose.append(keys[[i for i in article_blocks(blocks) if i not in stay]].ravel())
                fixed.append(keys[sorted(stay)].ravel())
            # a stage writes each of its partitions once
            first = (TaskContext.get().partitionId() << 32) + page
            page += len(part)
            yield part[["page_id", "url", "host"]].assign(
                page=np.arange(first, first + len(part)), loose=loose, fixed=fixed,
                texts=[[b.text for b in p] for p in parsed], tags=[[b.tag for b in p] for p in parsed],
                flags=[[sum(1 << i for i, flag in enumerate(b[2:]) if flag) for b in p] for p in parsed])


def _block_lists(rows: pd.DataFrame) -> list[list[Block]]:
    return [[Block(text, tag, *[bool(flags >> i & 1) for i in range(len(Block._fields) - 2)])
             for text, tag, flags in zip(*columns, strict=True)]
            for columns in zip(rows["texts"], rows["tags"], rows["flags"], strict=True)]


def _chunks(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one host that follow each other, ``CHUNK`` at most."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        new = (batch["host"] != batch["host"].shift()).cumsum()
        for _, part in batch.groupby(new, sort=False):
            if held and held[0]["host"].iloc[0] != part["host"].iloc[0]:
                yield pd.concat(held)
                held = []
            while len(part):
                room = CHUNK - sum(map(len, held))
                held.append(part.iloc[:room])
                part = part.iloc[room:]
                if sum(map(len, held)) >= CHUNK or sum(len(t) for h in held for texts in h["texts"] for t in texts) >= CHUNK_CHARS:
                    yield pd.concat(held)
                    held = []
    if held:
        yield pd.concat(held)


def _keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each chunk its pages, and the keys of its runs and places with the number of its pages that have them."""
    for number, chunk in enumerate(_chunks(batches)):
        host, parsed = chunk["host"].iloc[0], _block_lists(chunk)
        streams = [tokens_of(b) for b in parsed]
        _, places, pages = runs([tokens for tokens, _ in streams])
        keys = run_keys(np.concatenate([tokens for tokens, _ in streams]), host)[places]
        placed, alike = np.unique(np.concatenate(
            [place_keys(b, sizes, tokens, host)[article_blocks(b)].ravel() for b, (tokens, sizes) in zip(parsed, streams, strict=True)]),
            return_counts=True)
        keys = np.concatenate([keys, placed, [host_key(host)]])
        pages = np.concatenate([pages, alike, [sum(map(has_article, parsed))]])
        yield pd.DataFrame({"chunk": [(TaskContext.get().partitionId() << 32) + number], "pages": [chunk["page"].to_numpy()],
                            "keys": [keys.view(np.int64)], "counts": [pages.astype(np.int64)]})


def _extract(rows: pd.DataFrame) -> pd.DataFrame:
    """The main texts of a chunk, from its pages and the runs that repeat on the host."""
    repeats = rows["texts"].isna()
    keys = rows["key"][repeats].to_numpy(np.int64).view(np.uint64)
    totals = rows["total"][repeats].to_numpy(np.int64)
    order = np.argsort(keys)
    # one more key, larger than any, so that every search ends at a place
    keys, totals = np.append(keys[order], np.uint64(2**64 - 1)), np.append(totals[order], 1)
    chunk, texts = rows[~repeats], []
    for host, blocks in zip(chunk["host"], _block_lists(chunk), strict=True):
        tokens, sizes = tokens_of(blocks)
        stands, placed, pages = (
            np.where(keys[at] == mine, totals[at], 1)
            for mine in (run_keys(tokens, host), place_keys(blocks, sizes, tokens, host), np.array([host_key(host)]))
            for at in (np.searchsorted(keys, mine),))
        texts.append(main_text(blocks, sizes, spread(stands, len(tokens)), placed, int(pages[0])))
    return chunk[["page_id", "url"]].assign(text=texts)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def extracted(pages: DataFrame, html_column: str = "html", url_column: str = "url", id_column: str = "page_id") -> DataFrame:
    """The main text of every page; a null page counts as empty and gives an empty text.

    Pages without a readable host form one host. Repeated rows are read one by one, null ids are kept, and
    an empty table gives no rows.
    """
    rows = pages.select(
        F.col(f"`{id_column}`").alias("page_id"), F.col(f"`{url_column}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{html_column}`").cast("string"), F.lit("")).alias("html"),
        host_of(F.col(f"`{url_column}`").cast("string")).alias("host"))
    kind = rows.schema["page_id"].dataType.simpleString()
    held = staged(rows.mapInPandas(
        _parsed, f"page_id {kind}, url string, host string, page long, loose array<long>, fixed array<long>, "
        "texts array<string>, tags array<string>, flags array<int>"), "pages")
    unsure = staged(_unsure_hosts(held), "page-hosts")
    sure = held.join(unsure, "host", "left_anti").select("page_id", "url", F.array_join(_article_texts(), "\n\n").alias("text"))
    decided = _decided(held.join(unsure, "host", "left_semi"), kind)
    return sure.unionByName(decided).withColumn("n_chars", F.length("text").cast("long"))


def _article_texts() -> Column:
    """The texts of the blocks of a page's article."""
    return F.filter("texts", lambda _, i: F.get("flags", i).bitwiseAND(F.lit(3)) == 2)


def _unsure_hosts(held: DataFrame) -> DataFrame:
    """Hosts on which a block's runs have to be counted.

    These have a page with visible text but no article, or a block in an article that ``main_text`` could drop, as
    it stands at one place on enough of the host's pages. On all others articles stay whole.
    """
    articles = F.size("loose") + F.size("fixed") > 0
    visible = F.exists("flags", lambda f: f.bitwiseAND(F.lit(1)) == 0)
    plain = held.where(~articles & visible).select("host")
    places = held.select("host", F.explode(F.concat(
        F.transform("loose", lambda k: F.struct(k.alias("key"), F.lit(1).alias("loose"))),
        F.transform("fixed", lambda k: F.struct(k.alias("key"), F.lit(0).alias("loose"))))).alias("p"))
    placed = places.groupBy("host", "p.key").agg(F.count("*").alias("n"), F.max("p.loose").alias("loose"))
    often = placed.where((F.col("n") > PLACED * FEW) & (F.col("loose") == 1)).groupBy("host").agg(F.max("n").alias("n"))
    totals = held.where(articles).groupBy("host").agg((F.count("*") * MOST).alias("most"))
    movable = often.join(totals, "host").where(F.col("n") > PLACED * F.greatest(F.col("most"), F.lit(float(FEW))))
    return plain.union(movable.select("host")).distinct()


def _decided(held: DataFrame, kind: str) -> DataFrame:
    """The main texts of hosts whose runs are counted: every chunk's runs meet by key, those on two pages go back to the chunks."""
    spark = held.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["host", F.xxhash64("page")]
    near = held.select("page", "host", "texts", "tags", "flags").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    keyed = staged(near.mapInPandas(_keyed, "chunk long, pages array<long>, keys array<long>, counts array<long>"), "page-runs")
    each = keyed.select("chunk", F.explode(F.arrays_zip("keys", "counts")).alias("k")).select("chunk", F.col("k.keys").alias("key"), "k.counts")
    totals = each.groupBy("key").agg(F.sum("counts").alias("total")).where(F.col("total") > 1)
    repeats = each.select("chunk", "key").join(totals, "key")
    whole = held.join(keyed.select("chunk", F.explode("pages").alias("page")), "page").select(
        # without nulls in them, keys and totals stay whole numbers in pandas
        "chunk", "page_id", "url", "host", "texts", "tags", "flags", F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("total"))
    together = whole.unionByName(repeats, allowMissingColumns=True)
    return together.groupBy("chunk").applyInPandas(_extract, f"page_id {kind}, url string, text string")
