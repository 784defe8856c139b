"""Main text of web pages by a suffix array over each host's pages.

1. A page becomes blocks of text in page order. Scripts, styles, forms' fields, comments of the markup and
   the head are no text. Markup gives every block a mark: it stands in the article (article, main, or a
   container named like one), or in a part that is named as something else (nav, aside, footer, a header
   outside the article, form, or a class or id of NOT_MAIN, readers' comments among them), or neither.
2. The token streams of all blocks outside the articles are laid end to end for each host. Their suffixes are
   ordered by their first DEPTH tokens: range partitions, sorted inside. Neighbours with DEPTH equal tokens on
   pages of different content are a repeated substring, and its tokens are boilerplate. Groups cut by a
   partition's end are settled from the ends alone, two groups a partition. Pages of a host with the same
   stream count as one, so that a page that is stored twice does not lose its text.
3. A block goes if its markup names it as something else, or if more than half of its tokens are covered
   and it does not stand in an article. The unique rest stays, whole.

Text inside an explicit article stays even where another page repeats it: articles of one host share whole
paragraphs, which are text of each. Where no page of a host has such markup, repetition alone decides.

Defined results: null and empty html give an empty text. Pages of any length are read whole, one at a time.
Markup that is cut off or never closed ends with its page; an unfinished tag at the end is no text. Rows that repeat a page
are pages of their own. Null and unreadable urls are one host. Character references without their
semicolon are decoded where HTML does. Lines broken by br stay in one block, as a space. Further columns
are ignored. No rows give no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonja.llm.common import written

DEPTH = 8
OPEN, ARTICLE, OTHER = 0, 1, 2
#: Parts of class and id names that mark something other than the main text, and whole names that mark the article.
NOT_MAIN = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu "
    "modal nav navbar navigation newsletter notice notices pagination pager popup promo recommended related replies respond share sharing sidebar social "
    "sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
ARTICLE_NAMES = frozenset("article articlebody article-body article-content article-text entry-content post-body post-content story-body".split())
_NO_TEXT = frozenset("script style noscript template svg iframe object select button textarea canvas head title audio video math".split())
_RAW = frozenset("script style noscript iframe textarea title".split())
_OTHER_TAGS = frozenset("nav aside footer form dialog".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_SPACE = re.compile(r"\s+")
_TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<said>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?P<close>>)|</?[a-zA-Z][^>]*(?:>|\Z)",
    re.S,
)
_PLAIN = re.compile(r"<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<said>[^>]*)>\Z")  # quotes that do not pair
_NAMES = re.compile(r"(?:^|\s)(?:class|id|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.I)


def named(attributes: str, inside: bool = False) -> int:
    """What a tag's class, id or itemprop says; an article may have a header of its own."""
    said = OPEN
    for match in _NAMES.finditer(attributes):
        for name in (match[1] or match[2] or match[3] or "").lower().split():
            parts = re.split(r"[-_:]+", name)
            if name in ARTICLE_NAMES:
                said = ARTICLE
            elif parts[0] not in ("has", "with", "no", "is", "js"):
                hits = {name, parts[0], parts[-1]} & NOT_MAIN
                if hits - ({"header"} if inside else set()):
                    return OTHER
    return said


def blocks(page: str) -> list[tuple[int, str]]:
    """(mark, text) of the page's blocks with text, in order."""
    out, held = [], []
    stack: list[tuple[str, int, bool]] = []  # tag, mark, whether its text counts
    names: dict[str, int] = {}
    mark, counts, place, size = OPEN, True, 0, len(page)

    def finish():
        text = _SPACE.sub(" ", "".join(held)).strip()
        held.clear()
        if text:
            out.append((mark, text))

    def leave(tag: str):
        while stack:
            top = stack.pop()[0]
            names[top] -= 1
            if top == tag:
                return

    while place < size:
        found = _TAG.search(page, place)
        end = found.start() if found else size
        if counts and end > place:
            held.append(entities.unescape(page[place:end]))
        if not found:
            break
        place = found.end()
        if not found["tag"] and not (found := _PLAIN.match(found[0])):
            continue
        tag, said = found["tag"].lower(), found["said"]
        if tag == "br":
            held.append(" ")
        if tag not in _INLINE:
            finish()
        if found["end"]:
            if names.get(tag):
                leave(tag)
        elif tag in _RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, place)
            place = stop.end() if stop else size
            continue
        elif tag not in _VOID:
            if tag == "p" and names.get("p"):
                leave("p")
            above, shown = (stack[-1][1], stack[-1][2]) if stack else (OPEN, True)
            own = OPEN
            if tag not in _INLINE and tag not in ("html", "body"):
                own = named(said, above == ARTICLE)
                if tag in _OTHER_TAGS or (tag == "header" and above != ARTICLE):
                    own = OTHER
                elif tag in ("article", "main") and own == OPEN:
                    own = ARTICLE
            own = above if above == OTHER or own == OPEN else own
            stack.append((tag, own, shown and tag not in _NO_TEXT and not _HIDDEN.search(said)))
            names[tag] = names.get(tag, 0) + 1
        mark, counts = (stack[-1][1], stack[-1][2]) if stack else (OPEN, True)
    finish()
    return out


def host_of(url: str = "url"):
    """The host that a url names, in lower case; empty where it names none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


READ = "row long, page_id string, url string, host string, marks binary, main array<string>, rest array<string>, content long"


def _reader(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    row = TaskContext.get().partitionId() << 40
    for pdf in batches:
        out = []
        for page_id, url, host, page in zip(pdf["page_id"], pdf["url"], pdf["host"], pdf["html"]):
            found, row = blocks(page), row + 1
            # Named by its three longest blocks, so that other menus around it leave a page the same content.
            longest = sorted((t for m, t in found if m != OTHER), key=lambda t: (-len(t), t))[:3]
            content = xxhash.xxh3_64_intdigest("\n".join(longest).encode("utf-8", "surrogatepass")) >> 1
            out.append((row, page_id, url, host, bytes(m for m, _ in found), [t for m, t in found if m == ARTICLE], [t for m, t in found if m != ARTICLE], content))
        yield pd.DataFrame(out, columns=["row", "page_id", "url", "host", "marks", "main", "rest", "content"])


SUFFIX = "prefix binary, row long, place int, content long, wanted boolean"


def _suffixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The first DEPTH tokens from each place of a page's stream; a stream is cut where the article stands."""
    width = 4 * DEPTH
    for pdf in batches:
        prefixes, found = [], []
        for row, host, marks, rest, content in zip(pdf["row"], pdf["host"], pdf["marks"], pdf["rest"], pdf["content"]):
            marks, texts = bytes(marks), iter(rest)
            seed, stretch, at = xxhash.xxh32_intdigest(host), [], 0
            for m in [*marks, ARTICLE]:
                if m != ARTICLE:
                    stretch += [xxhash.xxh32_digest(w, seed) for w in next(texts).split()]
                elif stretch:
                    joined, n = b"".join(stretch), len(stretch) - DEPTH + 1
                    prefixes += [joined[i : i + width] for i in range(0, 4 * n, 4)]
                    found.append((row, content, OPEN in marks, at, max(n, 0)))
                    at, stretch = at + len(stretch), []
        if prefixes:
            row, content, wanted, at, n = (np.array(c) for c in zip(*found))
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at, n)
            yield pd.DataFrame({"prefix": prefixes, "row": np.repeat(row, n), "place": place.astype(np.int32), "content": np.repeat(content, n), "wanted": np.repeat(wanted, n)})


COVERED, PENDING, ENDING = 0, 1, 2
NEIGHBOURS = "kind int, prefix binary, row long, place int, lo long, hi long"


def _neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come in order of prefix: a group of equal prefixes with two contents is covered.

    A partition's first and last group may go on in the next one: what they hold is told, and their rows are pending.
    """
    group, first = None, True
    lo = hi = 0
    rows: list[pd.DataFrame] = []

    def done(edge: bool) -> Iterator[pd.DataFrame]:
        if edge:
            yield pd.DataFrame({"kind": [ENDING], "prefix": [group], "row": 0, "place": 0, "lo": lo, "hi": hi})
        if rows and (edge or lo < hi):
            held = pd.concat(rows)
            yield pd.DataFrame({"kind": COVERED if lo < hi else PENDING, "prefix": None if lo < hi else group, "row": held["row"], "place": held["place"], "lo": lo, "hi": hi})

    for pdf in batches:
        keys = pdf["prefix"].to_numpy()
        cut = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else []
        for a, b in zip(cut, np.append(cut[1:], len(keys)) if len(keys) else []):
            content, part = pdf["content"].to_numpy()[a:b], pdf.iloc[a:b]
            if keys[a] != group:
                if group is not None:
                    yield from done(first)
                    first = False
                group, rows, lo, hi = keys[a], [], content.min(), content.max()
            lo, hi = min(lo, content.min()), max(hi, content.max())
            part = part[part["wanted"]]
            if len(part):
                rows.append(part[["row", "place"]])
    if group is not None:
        yield from done(True)


def covered(pages: DataFrame) -> DataFrame:
    """row, places: starts of windows that the host repeats, for pages that have a block without a mark."""
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    suffixes = pages.filter(F.size("rest") > 0).select("row", "host", "marks", "rest", "content").mapInPandas(_suffixes, SUFFIX)
    ordered = suffixes.repartitionByRange(parts, "prefix", "row").sortWithinPartitions("prefix", "row")
    found = written(ordered.mapInPandas(_neighbours, NEIGHBOURS), "neighbours")
    # Two rows a partition at most, so that the table can be sent to all tasks.
    ended = found.filter(F.col("kind") == ENDING).groupBy("prefix").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo < hi")
    late = found.filter(F.col("kind") == PENDING).join(F.broadcast(ended.select("prefix")), "prefix", "left_semi")
    rows = found.filter(F.col("kind") == COVERED).select("row", "place").unionByName(late.select("row", "place"))
    return rows.groupBy("row").agg(F.collect_list("place").alias("places"))


def unique_blocks(marks: bytes, main: list[str], rest: list[str], places) -> list[str]:
    """The page's blocks without those that their mark or the host's repetition takes away."""
    sizes = [len(t.split()) for t in rest]
    gone = np.zeros(sum(sizes) + DEPTH, np.int64)
    if places is not None and len(places):
        at = np.asarray(places, np.int64)
        np.add.at(gone, at, 1)
        np.add.at(gone, at + DEPTH, -1)
    gone = np.append(0, np.cumsum(np.cumsum(gone) > 0))
    out, article, other, at = [], iter(main), iter(rest), 0
    for m in marks:
        if m == ARTICLE:
            out.append(next(article))
            continue
        text = next(other)
        end = at + len(text.split())
        if m == OPEN and 2 * (gone[end] - gone[at]) <= end - at:
            out.append(text)
        at = end
    return out


def _assembled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = ["\n".join(unique_blocks(bytes(m), main, rest, p)) for m, main, rest, p in zip(pdf["marks"], pdf["main"], pdf["rest"], pdf["places"])]
        yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts})


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    kind = pages.schema["page_id"].dataType
    # Ids pass through Python as text, as pandas would turn longs with nulls into doubles.
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", host_of().alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    read = written(rows.mapInPandas(_reader, READ), "blocks")
    undecided = F.position(F.lit(bytes([OPEN])), F.col("marks")) > 0
    some = read.filter(undecided).join(covered(read), "row", "left").select("page_id", "url", "marks", "main", "rest", "places")
    some = some.mapInPandas(_assembled, "page_id string, url string, text string")
    sure = read.filter(~undecided).select("page_id", "url", F.array_join("main", "\n").alias("text"))
    return sure.unionByName(some).select(F.col("page_id").cast(kind).alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
