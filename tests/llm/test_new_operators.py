"""Lexical search, the prefix trie and page texts against plain versions, on tables with nulls, ties, repeats and odd columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lonja.llm import html_text, lexical, prefix_trie
from lonja.llm.common import written

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, term string, shard long, n long, score string"
ITEMS = "item_id long, text string, grp int, w long"


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_search(docs, items, k):
    docs = [(d, Counter(terms_of(t)), len(terms_of(t))) for d, t in docs if terms_of(t)]
    n_docs, n_terms, df = len(docs), sum(n for _, _, n in docs), Counter(t for _, c, _ in docs for t in c)
    wanted = defaultdict(set)
    for item, text in items:
        wanted[item] |= set(terms_of(text))
    out = []
    for item, words in wanted.items():
        found = []
        for d, c, n in docs:
            m = 10 + (90 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in words if t in c)
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, f[3], -f[0]) for i, f in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def search_case():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(60)] + ["Ärger", "naïve", "X1", "日本"]
    text = lambda n: " ".join(rng.choice(vocab) if rng.random() < 0.7 else vocab[int(rng.paretovariate(1)) % 60] for _ in range(n))
    docs = [(i, text(rng.randrange(1, 40))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)]  # equal scores
    docs += [(5, docs[5][1]), (5, text(9)), (None, docs[7][1]), (None, None), (400, None), (401, ""), (402, " .,;"), (403, text(20_000)), (404, "ÄRGER Naïve"), (-3, docs[7][1])]
    items = [(i, text(rng.randrange(1, 12))) for i in range(12)]
    items += [(3, text(4)), (None, docs[7][1]), (50, None), (51, ""), (52, "nowhere absent"), (53, docs[7][1].upper()), (54, text(5000))]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"vocabulary": 3, "shard_terms": 600, "group_rows": 40}, {"k": 3, "shard_terms": 200}])
def test_search_is_the_plain_one(spark, options):
    docs, items = search_case()
    frame = spark.createDataFrame([(d, t, "x", 1, 2, "s") for d, t in docs], DOCS).repartition(3)
    asked = spark.createDataFrame([(i, t, 1, 2) for i, t in items], ITEMS)
    got = [(r.item_id, r.rank, r.doc_id, r.score) for r in lexical.search(frame, asked, **options).collect()]
    assert sorted(got, key=repr) == plain_search(docs, items, options.get("k", 10))


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b", 1, 2)], ITEMS)
    some = spark.createDataFrame([(1, "a", "x", 1, 2, "s")], DOCS)
    assert lexical.search(docs, items).count() == 0
    assert lexical.search(some, items.filter("false")).count() == 0


def test_block_maxima_spare_unpacking():
    """A common word beside a rare one: the common word's blocks without a candidate stay packed, and nothing is lost."""
    rng = np.random.default_rng(2)
    size = 40_000
    m = rng.integers(20, 400, size)
    lists = []
    for share, w in ((0.9, 60), (0.5, 400), (0.001, 8000)):
        places = np.flatnonzero(rng.random(size) < share)
        tf = rng.integers(1, 5, len(places))
        bound, head, packed = lexical.packed_list(places, tf, m[places])
        p = lexical.Postings(len(places), bound, head, packed)
        got_places, gain = p.unpack(np.arange(len(p.last)))
        assert (got_places == places).all() and (gain == lexical.impact(tf, m[places])).all()
        lists.append((w, p, places, lexical.impact(tf, m[places])))
    score = np.zeros(size, np.int64)
    for w, _, places, gain in lists:
        score[places] += w * gain
    order = np.lexsort((np.arange(size), -score))[:10]
    for _, p, _, _ in lists:
        p.unpacked = 0
    places, scores = lexical.best_of([(w, p) for w, p, _, _ in lists], size, 10)
    assert places.tolist() == order.tolist() and scores.tolist() == score[order].tolist()
    assert lists[0][1].unpacked < len(lists[0][1].last) / 2


CONVERSATIONS = "conv_id long, turn long, role string, text string, depth int, key string, n long, salt int"


def plain_trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in turns.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + ts[h:])
    nodes = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            nodes[ts[:d]].append(c)
    kids, leaves, saved = Counter(p[:-1] for p in nodes if p), Counter(), Counter()
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1]) if p else 0
    ends = {p: ",".join(str(c) for c in sorted(m) if built[c] == p) for p, m in nodes.items()}
    return sorted(
        [(min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in nodes.items()], key=repr
    )


def conversation_rows():
    rng = random.Random(9)
    says = ["hello", "", "wie geht's", "é" * 30, "long " * 4000, None]
    rows = []
    for c in [*range(0, 40), *range(100, 130), *range(250, 262), 1000, 7, -5, -120]:
        for turn in range(rng.randrange(0, 9)):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(says)))
    rows += [(5000 + i, t, "user", f"same {t}") for i in range(60) for t in range(7)]  # one conversation many times
    rows += [(6000 + i, t, "user", "first" if t == 0 else f"{i}") for i in range(30) for t in range(3)]  # one first turn
    rows += [(7777, t, "user", str(t)) for t in range(300)]  # a chain of its own
    rows += [(8, None, "user", "null turn"), (8, None, None, None), (9, 1, "user", "again"), (9, 1, "user", "again"), (None, 1, "user", "nobody"), (9100, 0, "user", "only one")]
    return rows


def test_trie_is_the_plain_one(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    rows = conversation_rows()
    frame = spark.createDataFrame([(*r, 1, "k", 2, 3) for r in rows], CONVERSATIONS).repartition(3)
    found = prefix_trie.trie(*prefix_trie.rebuilt(written(prefix_trie.numbered(frame), "turns")))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in found.select(names).collect()), key=repr) == plain_trie(rows)


def test_trie_of_nothing(spark):
    frame = spark.createDataFrame([], CONVERSATIONS)
    assert prefix_trie.trie(*prefix_trie.rebuilt(written(prefix_trie.numbered(frame), "turns"))).count() == 0


PAGES = "page_id long, url string, html string, host string, row long, text string"
NAV = '<div><span>Home</span> <a href="/">News</a> <a href="/w">World</a> Sports Weather Travel Culture Shop</div>'


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def test_repetition_decides_where_markup_does_not(spark):
    rng = random.Random(4)
    foot = f"<div>{words(rng, 20)}</div>"
    want, rows = {}, []
    for i in range(30):
        host = "a.example" if i < 20 else f"h{i % 2}.example"
        paragraphs = [words(rng, rng.randrange(3, 60)) for _ in range(4)]
        want[i] = "\n".join(paragraphs)
        rows.append((i, f"http://{host}/p/{i}", "<body>" + NAV + "".join(f"<p>{p}" for p in paragraphs) + (foot if host == "a.example" else "") + "</body>"))
    rows.append((40, "https://A.example:80/copy?x=1", rows[3][2]))  # stored twice: keeps its text
    want[40] = want[3]
    rows.append((41, "http://alone.example/", "<body>" + NAV + "<p>x</p>"))  # nothing repeats on its host
    want[41] = "Home News World Sports Weather Travel Culture Shop\nx"
    frame = spark.createDataFrame([(*r, "h", 1, "t") for r in rows], PAGES).repartition(4)
    for parts in ("3", "40"):  # many partitions cut the groups of equal suffixes
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = {r.page_id: (r.text, r.n_chars) for r in html_text.main_text(frame).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert got == {k: (v, len(v)) for k, v in want.items()}


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("plain &lt;b&gt; &amp;amp; &copy &#233; &nbsp; x", "plain <b> &amp; © é x"),
        ("<title>no</title><p>one\n two<p>three</p>four<br>five", "one two\nthree\nfour five"),
        ("<script>var t='</p>';</script><style>p{}</style><!-- <p>no</p> --><p>yes", "yes"),
        ("<nav>a</nav><header>b</header><article><header><h1>T</h1></header><p>x <b>y</p><aside>no</aside></article><footer>f</footer>", "T\nx y"),
        ('<div class="sidebar">a</div><div id="cookie-notice">b</div><section class="reader-comments"><article>c</article></section><form>d <input></form><p>text', "text"),
        ('<article class="post has-sidebar"><h1>T</h1>a < b<div class="share">no</div></article>', "T\na < b"),
        ("<article><p>cut off &am", "cut off &am"),
        ("<article><p>cut off</p><p cla", "cut off"),
        ("<p hidden>no</p><p style='display:none'>no</p><p>yes</p>", "yes"),
        ('<p title="a>b">x</p><p title="open>y</p>', "x\ny"),
        ("<ul><li>a<li>b</ul><table><tr><td>c</td><td>d</td></table>", "a\nb\nc\nd"),
        ("<article>" + "<p>long text</p>" * 20000 + "</article>", "\n".join(["long text"] * 20000)),
    ],
)
def test_pages(spark, page, text):
    frame = spark.createDataFrame([(1, None, page, "h", 1, "t"), (None, "http://x", page, "h", 1, "t")], PAGES)
    got = html_text.main_text(frame).collect()
    assert sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in got) == [(0, "http://x", text, len(text)), (1, "", text, len(text))]


def test_no_pages(spark):
    assert html_text.main_text(spark.createDataFrame([], PAGES)).count() == 0
