"""Ranked lexical search: Block-Max MaxScore over shards of posting lists.

1. One pass over the texts counts documents with terms and terms (N, L). The length part m of each document
   follows from them.
2. The index is built where the documents stand: a task cuts its documents into shards of about SHARD terms,
   in order of doc_id, and writes one row per shard and term: postings in blocks of BLOCK, each with its first
   and last place, its largest impact and packed offsets and counts. No text is shuffled. Where the queries'
   distinct terms are few (`vocabulary`, checked), only their lists are written; the results are the same.
3. Document frequencies are sums over the index rows, weights follow from them.
4. Shards meet the items in blocks: an item belongs to one of several groups, every group has a bounded
   number of term rows, and a shard gets a group's lists and its items together. For each item, documents
   are taken in ranges. Global bounds (weight by the list's largest impact) in ascending order split the
   lists: those whose sum of bounds cannot pass the item's k-th best score are non-essential. Documents of
   the essential lists are candidates; the blocks' largest impacts in the non-essential lists reject them,
   and only blocks that still have a candidate are unpacked.
5. A shard gives its heap of k documents an item, and the heaps are merged: every task keeps k rows an item
   before the last shuffle.

Scores are whole numbers: floor(1000 ln((2N+2)/(2df+1))) times floor(10^9 tf / (1000 tf + 8m)), summed.

Defined results: null and empty texts have no terms; they are neither counted nor found. Very long texts are
counted whole and make a shard of their own at most. An item is an item_id (null is one, too): its terms are
those of all rows that repeat it, once each. Rows that repeat a doc_id are documents of their own, rank one
after the other and may both be found; a null doc_id comes after all others at equal scores (inside, the largest long stands for null). Equal scores go to
the smaller doc_id. Terms that no document has add nothing. Further columns are ignored. No documents or no
items give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lonja.llm.common import written

#: The contract's terms, as a Java pattern on texts and as a pattern on UTF-8 bytes.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
BLOCK, RANGE = 128, 4096
#: Terms of a shard; distinct query terms that are sent to every task at most; term rows of a group of items.
SHARD, VOCABULARY, ITEMS, SALTS = 8_000_000, 200_000, 100_000, 64
_LAST = np.iinfo(np.int64).max
INDEX = "shard long, term string, n long, bound long, head binary, packed binary"
FOUND = "item_id long, doc_id long, score long"


def lowered(text: str = "text"):
    """The text with A-Z lower-cased and nothing else."""
    return F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def statistics(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and terms of all."""
    n = F.coalesce(F.regexp_count("text", F.lit(TERM)), F.lit(0)).cast("long")
    found = docs.select(n.alias("n")).agg(F.count_if(F.col("n") > 0).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    return found["N"], found["L"]


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def packed_list(places: np.ndarray, tf: np.ndarray, m: np.ndarray) -> tuple[int, bytes, bytes]:
    """(largest impact, block heads, packed postings) of a list sorted by place.

    A head has a block's first place, last place and largest impact. Postings are offsets from the block's
    first place, counts and length parts, each in as few bytes as the list allows.
    """
    cut = np.arange(0, len(places), BLOCK)
    best = np.maximum.reduceat(impact(tf, m), cut)
    first = places[cut]
    head = np.stack([first, places[np.append(cut[1:], len(places)) - 1], best]).astype("<i8")
    columns = (places - np.repeat(first, BLOCK)[: len(places)], tf, m)
    widths = [np.min_scalar_type(int(c.max())) for c in columns]
    return int(best.max()), head.tobytes(), bytes(w.itemsize for w in widths) + b"".join(c.astype(w.newbyteorder("<")).tobytes() for c, w in zip(columns, widths))


class Postings:
    """A packed list, unpacked block by block."""

    def __init__(self, n: int, bound: int, head: bytes, packed: bytes):
        self.n, self.bound, self.unpacked = n, bound, 0
        self.first, self.last, self.best = np.frombuffer(head, "<i8").reshape(3, -1)
        self.columns, at = [], 3
        for width in packed[:3]:
            self.columns.append(np.frombuffer(packed, f"<u{width}", n, at))
            at += width * n

    def blocks_of(self, places: np.ndarray) -> np.ndarray:
        """The block that could hold each place, or one past the last."""
        return np.searchsorted(self.last, places)

    def unpack(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and impacts of the postings in some blocks."""
        self.unpacked += len(blocks)
        at = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        at = at[at < self.n]
        offset, tf, m = (c[at].astype(np.int64) for c in self.columns)
        return self.first[at // BLOCK] + offset, impact(tf, m)


def best_of(lists: list[tuple[int, Postings]], size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the k best of `size` documents with a score above 0; equal scores by place."""
    lists = sorted(((w, p) for w, p in lists if w > 0 and p.bound > 0), key=lambda x: x[0] * x[1].bound)
    below = np.cumsum([0] + [w * p.bound for w, p in lists])  # what the lists before each one can add
    top_places, top_scores, floor = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for start in range(0, size, RANGE):
        end = min(start + RANGE, size)
        essential = int(np.searchsorted(below[1:], floor, side="right"))
        score, seen = np.zeros(end - start, np.int64), np.zeros(end - start, bool)
        for w, p in lists[essential:]:
            a, b = np.searchsorted(p.last, start), np.searchsorted(p.first, end)
            if a < b:
                places, gain = p.unpack(np.arange(a, b))
                inside = (places >= start) & (places < end)
                places = places[inside] - start
                score[places] += w * gain[inside]
                seen[places] = True
        live = np.flatnonzero(seen)
        for i in range(essential - 1, -1, -1):
            if not len(live):
                break
            w, p = lists[i]
            at = p.blocks_of(live + start)
            held = at < len(p.last)
            held[held] = p.first[at[held]] <= live[held] + start
            bound = score[live] + below[i] + np.where(held, w * p.best[np.minimum(at, len(p.last) - 1)], 0)
            keep = bound > floor  # a later document with the floor's score has the larger doc_id
            live, at, held = live[keep], at[keep], held[keep]
            if held.any():
                places, gain = p.unpack(np.unique(at[held]))
                inside = (places >= start) & (places < end)
                score[places[inside] - start] += w * gain[inside]
        live = live[score[live] > floor]
        if len(live):
            places, scores = np.append(top_places, live + start), np.append(top_scores, score[live])
            order = np.lexsort((places, -scores))[:k]
            top_places, top_scores = places[order], scores[order]
            if len(order) == k:
                floor = int(top_scores[-1])
    return top_places, top_scores


def _indexer(n_docs: int, n_terms: int, words: frozenset[bytes] | None, shard_terms: int):
    def shard(number: int, names: dict[bytes, int], rows: list[tuple[int, int, np.ndarray]]) -> pd.DataFrame:
        rows.sort(key=lambda r: r[0])
        ids = np.array([r[0] for r in rows], np.int64)
        term, tf = np.concatenate([r[2] for r in rows], axis=1)
        sizes = [r[2].shape[1] for r in rows]
        # In Python's integers, as the product of three counts could pass 64 bits.
        m = np.repeat(np.array([10 + (90 * r[1] * n_docs) // n_terms for r in rows], np.int64), sizes)
        place = np.repeat(np.arange(len(rows)), sizes)
        order = np.argsort(term, kind="stable")
        cut = np.append(0, np.cumsum(np.bincount(term, minlength=len(names))))
        place, tf, m = place[order], tf[order].astype(np.int64), m[order]
        out = [(number, None, len(rows), 0, ids.astype("<i8").tobytes(), None)]
        for t, a, b in zip(names, cut[:-1], cut[1:]):
            out.append((number, t.decode("utf-8", "replace"), b - a, *packed_list(place[a:b], tf[a:b], m[a:b])))
        return pd.DataFrame(out, columns=["shard", "term", "n", "bound", "head", "packed"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, names, rows, held = TaskContext.get().partitionId() << 24, {}, [], 0
        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                found = _TERM.findall(text.encode("utf-8", "surrogatepass").lower())
                counts = Counter(found)
                kept = counts if words is None else {t: c for t, c in counts.items() if t in words}
                if kept:
                    rows.append((doc_id, len(found), np.array([[names.setdefault(t, len(names)) for t in kept], list(kept.values())], np.int32)))
                held += len(found)
                if held >= shard_terms:
                    if rows:
                        yield shard(number, names, rows)
                    number, names, rows, held = number + 1, {}, [], 0
        if rows:
            yield shard(number, names, rows)

    return run


def index(docs: DataFrame, n_docs: int, n_terms: int, words: frozenset[bytes] | None = None, shard_terms: int = SHARD) -> DataFrame:
    """The index as a table: rows of INDEX; a shard's row without term holds the doc_ids of its places."""
    rows = docs.select(_held("doc_id"), "text").filter("text IS NOT NULL")
    return written(rows.mapInPandas(_indexer(n_docs, n_terms, words, shard_terms), INDEX), "index")


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term: each item's distinct terms."""
    found = F.regexp_extract_all(lowered(), F.lit(TERM), F.lit(0))
    return items.select(_held("item_id"), F.explode(F.array_distinct(found)).alias("term")).distinct()


def _held(column: str):
    """An id, null as the largest one; pandas would turn longs with nulls into doubles."""
    return F.coalesce(F.col(column), F.lit(int(_LAST))).alias(column)


def _given(column: str):
    return F.expr(f"nullif({column}, {int(_LAST)}L)").alias(column)


def _searcher(k: int):
    def run(key, lists: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        none, out = lists["term"].isna(), [pd.DataFrame(columns=["item_id", "doc_id", "score"])]
        if none.any() and len(asked):
            ids = np.frombuffer(bytes(lists.loc[none, "head"].iloc[0]), "<i8")
            names = ["term", "w", "n", "bound", "head", "packed"]
            held = {t: (int(w), Postings(int(n), int(b), bytes(h), bytes(p))) for t, w, n, b, h, p in lists.loc[~none, names].itertuples(index=False)}
            for item in asked["items"].iloc[0]:
                places, scores = best_of([held[t] for t in item["terms"] if t in held], len(ids), k)
                out.append(pd.DataFrame({"item_id": item["item_id"], "doc_id": ids[places], "score": scores}))
        return pd.concat(out[1:] or out)

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 10, vocabulary: int = VOCABULARY, group_rows: int = ITEMS, shard_terms: int = SHARD) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents."""
    terms = written(item_terms(items), "item-terms")
    distinct = [r["term"].encode("utf-8") for r in terms.select("term").distinct().limit(vocabulary + 1).collect()]
    n_docs, n_terms = statistics(docs)
    rows = index(docs, n_docs, n_terms, None if len(distinct) > vocabulary else frozenset(distinct), shard_terms)
    lists, places = rows.filter("term IS NOT NULL"), rows.filter("term IS NULL")

    groups = max(1, math.ceil(terms.count() / group_rows))
    terms = terms.withColumn("grp", F.pmod(F.xxhash64("item_id"), F.lit(groups)).cast("int"))
    df = lists.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    w = F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weighed = terms.select("term", "grp").distinct().join(df.select("term", w.alias("w")), "term")

    # A group of items is one row of bounded size; every shard gets each once. Salts spread the shards over tasks.
    each = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp")
    packs = terms.groupBy("grp", "item_id").agg(F.collect_list("term").alias("terms"))
    packs = packs.groupBy("grp").agg(F.collect_list(F.struct("item_id", "terms")).alias("items"))
    packs = packs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    asked = places.select(F.col("shard").alias("at"), each, F.pmod(F.xxhash64("shard"), F.lit(SALTS)).cast("int").alias("salt")).join(packs, ["grp", "salt"]).drop("salt")
    columns = ["shard", "grp", "term", "w", "n", "bound", "head", "packed"]
    places = places.select("*", each, F.lit(None).cast("long").alias("w")).select(columns)
    met = lists.join(weighed, "term").select(columns).unionByName(places)
    found = met.groupBy("shard", "grp").cogroup(asked.groupBy("at", "grp")).applyInPandas(_searcher(k), FOUND)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select(_given("item_id"), "rank", _given("doc_id"), "score")


#: The same result as DuckDB SQL.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL),
n AS (SELECT row_id, doc_id, terms, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0),
s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM n),
tf AS (SELECT row_id, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT row_id, doc_id, n, unnest(terms) AS term FROM n) GROUP BY ALL),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM df, s),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
found AS (SELECT item_id, row_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN tf USING (term), s GROUP BY ALL),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, row_id) AS INTEGER) AS rank, doc_id, score FROM found WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
