"""Near-duplicate detection by circulant MinHash, banding and exact verification.

Signatures use two permutations: the first scatters a text's shingles over a universe of 2**32 places, the
second is applied after a circular shift by 0, 1, 2, ... places; the minimum under each shift is one
coordinate. Bands of `rows` coordinates make candidates; the number of bands is set so that a pair right
at the threshold is missed with a chance below 1e-7.

No pairs are expanded within a bucket. Texts with the same shingle set collapse to one node first. Each
bucket then gives a star (its smallest node against the others); stars are verified on full sets, a large
hub's spokes under several keys, and joined into components. Buckets that still hold more than one
component are settled in three steps, none of which leaves out a pair that could be linked:

1. Shingles are counted over all nodes of such buckets. A node shares at most its shingles that some other
   node has; where even that cannot reach the threshold with the smallest partner in its buckets, the node
   has no link and leaves. One pass, in proportion to the sets. It removes nodes that are near to a large
   group but linked with none of it.
2. The nodes outside a bucket's commonest component are compared with one cell of its nodes.
3. What is still outside is compared with all nodes of the bucket, in cells of bounded size.

A pair is compared only while its two nodes are in different components. Step 3 costs rows in proportion to
a bucket as long as no more than a cell of its nodes stays outside; beyond that, the product of both over
the cell size.

Defined results: null and empty texts, and texts without words, have no shingles, link with nothing and
are kept, each row of them. Rows that repeat a doc_id with one text are one node and are flagged alike;
`drop_near_duplicates` leaves one row of a group, whatever repeats. Null doc_ids are never the smallest;
a group of null ids only has a null component_id. Very long texts are sketched whole: a signature has a
fixed size, and a text's set is held once in the task that reads it. Columns besides doc_id and text may
have any name: they are carried along as one struct. No rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonja.llm.common import written
from lonja.llm.components import components

ROWS, MEMO, CELL, SPOKES = 4, 500_000, 256, 512
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def bands_for(percent: int, rows: int = ROWS, miss: float = 1e-7) -> int:
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


class WordHash(dict):
    """word -> 64-bit hash, memoised."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, width: int, memo: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a whole text's shingles; bytes.split cuts at exactly the contract's spaces."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(memo) > MEMO:
        memo.clear()
    w = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(width, len(w))
    h = np.full(len(w) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        h = (h ^ w[i : len(w) - width + 1 + i]) * _ODD[i % len(_ODD)]
        h ^= h >> np.uint64(29)
    return np.unique(h)


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 32-bit places, in place."""
    for shift, odd in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        x ^= x >> np.uint32(shift)
        x *= np.uint32(odd)
    x ^= x >> np.uint32(16)
    return x


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """Coordinate k: the least place, under the second permutation, of the first permutation's places shifted k around."""
    scattered = ((shingles * _ODD[0]) >> np.uint64(32)).astype(np.uint32)
    shifts, best = np.arange(size, dtype=np.uint32), np.full(size, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(scattered), 512):
        np.minimum(best, _mix(scattered[at : at + 512, None] + shifts).min(axis=0), out=best)
    return best


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    s = sig.reshape(-1, rows).astype(np.uint64)
    h = np.arange(1, len(s) + 1, dtype=np.uint64)
    for i in range(rows):
        h = (h ^ s[:, i]) * _ODD[i]
        h ^= h >> np.uint64(31)
    return h.astype(np.int64)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _sketcher(width: int, bands: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = WordHash()
        for pdf in batches:
            n, nodes, keys = [], [], []
            for t in pdf["text"]:
                s = shingle_set(t, width, memo)
                n.append(len(s))
                nodes.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(band_keys(signature(s, bands * ROWS)) if len(s) else None)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "mark": pdf["mark"], "n": n, "node": nodes, "keys": keys})

    return run


def _sets(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = WordHash()
        for pdf in batches:
            out = []
            for node, t, keys in zip(pdf["node"], pdf["text"], pdf["keys"]):
                s = shingle_set(t, width, memo).tobytes()
                if xxhash.xxh3_128_digest(s) == bytes(node):  # 64 bits of a text's hash may name several texts
                    out.append((bytes(node), s, keys))
            yield pd.DataFrame(out, columns=["node", "shingles", "keys"])

    return run


def _verifier(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(pdf["sa"], pdf["sb"])]
            yield pdf.loc[ok, ["a", "b"]]

    return run


def _cell(percent: int):
    """Links within one cell: nodes of side x against those of side y, skipping pairs already in one component."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        root: dict[bytes, bytes] = {}

        def find(x: bytes) -> bytes:
            while (up := root.setdefault(x, x)) != x:
                root[x] = root[up] if up in root else up
                x = root[x]
            return x

        band, sets = int(pdf["band"].iloc[0]), [frozenset(np.frombuffer(x, np.uint64).tolist()) for x in pdf["shingles"]]
        keys = np.stack(pdf["keys"].tolist())[:, :band]
        names, labels = [bytes(n) for n in pdf["node"]], [bytes(l) for l in pdf["label"]]
        side = pdf["x"].to_numpy(dtype=bool)
        size = np.array([len(x) for x in sets])
        ys, out = np.flatnonzero(~side), []
        for i in np.flatnonzero(side).tolist():
            fits = 100 * np.minimum(size[ys], size[i]) >= percent * np.maximum(size[ys], size[i])
            seen = (keys[ys] == keys[i]).any(axis=1)  # together in an earlier band, which compares them
            for j in ys[fits & ~seen].tolist():
                if find(labels[i]) != find(labels[j]):
                    both = len(sets[i] & sets[j])
                    if 100 * both >= percent * (size[i] + size[j] - both):
                        out.append((names[i], names[j]))
                        root[find(labels[i])] = find(labels[j])
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def _shingle_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each batch's nodes: every shingle, in how many of them it is, and the node (as two numbers) where that is one."""
    for pdf in batches:
        sets = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
        names = np.frombuffer(b"".join(map(bytes, pdf["node"])), "<i8").reshape(-1, 2)
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        shingle, first, n = np.unique(np.concatenate(sets), return_index=True, return_counts=True)
        of = names[owner[first]]
        yield pd.DataFrame({"shingle": shingle.astype(np.int64), "n": n, "hi": of[:, 0], "lo": of[:, 1]})


def _halves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        names = np.frombuffer(b"".join(map(bytes, pdf["node"])), "<i8").reshape(-1, 2)
        yield pdf.assign(hi=names[:, 0], lo=names[:, 1])


def _mixed(members: DataFrame, label: DataFrame) -> DataFrame:
    """The buckets that hold several components: band, key, node, n, label and the label of the commonest component."""
    labelled = members.filter("m > 2").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    parts = labelled.groupBy("band", "key", "label").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("y"))
    mixed = parts.groupBy("band", "key").agg(
        F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("parts"), F.sum("n").alias("size"), F.bit_xor("x").alias("x"), F.sum("y").alias("y")
    ).filter("parts > 1")
    once = mixed.groupBy("size", "x", "y").agg(F.min(F.struct("band", "key", F.col("top.label").alias("main"))).alias("b")).select("b.*")  # buckets of the same nodes count once
    return labelled.select("band", "key", "node", "n", "label").join(once, ["band", "key"])


def _linkable(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The nodes of mixed buckets that enough shared shingles could link with some other node there."""
    least = rest.groupBy("band", "key").agg(F.min("n").alias("low"))
    nodes = rest.join(least, ["band", "key"]).groupBy("node").agg(F.first("n").alias("n"), F.min("low").alias("low"))
    counts = nodes.select("node").join(sets.select("node", "shingles"), "node").mapInPandas(_shingle_counts, "shingle long, n long, hi long, lo long")
    own = counts.groupBy("shingle").agg(F.sum("n").alias("n"), F.max("hi").alias("hi"), F.max("lo").alias("lo")).filter("n = 1")
    own = own.groupBy("hi", "lo").agg(F.count("*").alias("own"))
    shared = nodes.mapInPandas(_halves, "node binary, n long, low long, hi long, lo long").join(own, ["hi", "lo"], "left").withColumn("shared", F.col("n") - F.coalesce("own", F.lit(0)))
    partner = F.greatest(F.col("low"), F.ceil(F.col("n") * percent / 100))
    return shared.filter(100 * F.col("shared") >= percent * (F.col("n") + partner - F.col("shared"))).select("node")


def _across(rest: DataFrame, sets: DataFrame, percent: int, sampled: bool) -> DataFrame:
    """Links of the nodes outside a bucket's main component with all of its nodes; sampled: with one cell of them."""
    count = rest.groupBy("band", "key").agg(F.count("*").alias("size"), F.count(F.when(F.col("label") != F.col("main"), 1)).alias("others")).filter("others > 0 AND size > 1")
    rest = rest.join(count, ["band", "key"])
    chunk = lambda n: F.pmod(F.xxhash64("node"), F.ceil(F.col(n) / CELL)).cast("long")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / CELL) - 1))
    xs = rest.filter("label <> main").select("band", "key", "node", "label", F.lit(True).alias("x"), chunk("others").alias("i"), F.lit(0).cast("long").alias("j") if sampled else upto("size").alias("j"))
    ys = rest.withColumn("j", chunk("size")).filter("j = 0" if sampled else "true").select("band", "key", "node", "label", F.lit(False).alias("x"), upto("others").alias("i"), "j")
    return xs.unionByName(ys).join(sets, "node").groupBy("band", "key", "i", "j").applyInPandas(_cell(percent), "a binary, b binary")


def _joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """The labels once these links count too: components of components, so only what the links touch is gone through."""
    of = lambda x: label.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    moved = written(components(ends), "moved").withColumnRenamed("node", "old").withColumnRenamed("label", "new")
    was = label.unionAll(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(label, "node", "left_anti").select("node", F.col("node").alias("label")))
    return was.join(moved, F.col("label") == F.col("old"), "left").select("node", F.coalesce("new", "label").alias("label"))


def _starred(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Each bucket's smallest node against the others, on full sets. A hub's spokes are dealt over keys of about SPOKES each."""
    wide = 100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n")
    stars = members.filter((F.col("node") != F.col("hub.node")) & wide).groupBy(F.col("hub.node").alias("a"), F.col("node").alias("b")).agg(F.max("m").alias("m"))
    stars = stars.withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("m") / SPOKES)))
    hubs = stars.groupBy("a").agg(F.max("salt").alias("most")).join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    hubs = hubs.select("a", "sa", F.explode(F.sequence(F.lit(0).cast("long"), "most")).alias("salt"))
    spokes = stars.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    return spokes.join(hubs, ["a", "salt"]).select("a", "b", "sa", "sb").mapInPandas(_verifier(percent), "a binary, b binary")


def _grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, mark (hash of the text), n, node and, where there are shingles, the first row of the component, for every row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    bands = bands_for(percent)
    rows = written(texts.mapInPandas(_sketcher(width, bands), "doc_id long, mark long, n long, node binary, keys array<long>"), "sketches")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")
    nodes = written(rows.filter("node IS NOT NULL").groupBy("node").agg(F.min(first).alias("first"), F.first("n").alias("n"), F.first("keys").alias("keys")), "nodes")
    spread = nodes.select("node", "n", F.posexplode("keys").alias("band", "key"))
    buckets = spread.groupBy("band", "key").agg(F.min(F.struct("node", "n")).alias("hub"), F.count("*").alias("m")).filter("m > 1")
    members = written(spread.join(buckets, ["band", "key"]).select("band", "key", "m", "hub", "node", "n"), "members")
    wanted = members.select("node").distinct().join(nodes.select("node", F.col("first.doc_id").alias("id"), F.col("first.mark").alias("of"), "keys"), "node")
    wanted = texts.join(wanted, (F.col("mark") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id")))
    sets = written(wanted.select("node", "text", "keys").mapInPandas(_sets(width), "node binary, shingles binary, keys array<long>").dropDuplicates(["node"]), "sets")
    links = written(_starred(members, sets, percent), "links")
    label = written(components(links), "labels")

    rest = written(_mixed(members, label), "mixed")
    linkable = written(_linkable(rest, sets, percent), "linkable")
    some = written(rest.join(linkable, "node"), "mixed")
    for sampled in (True, False):
        found = written(_across(some, sets, percent, sampled), "links")
        if not found.isEmpty():
            label = written(_joined(label, found), "labels")
            if sampled:
                some = written(_mixed(members.join(linkable, "node"), label), "mixed")

    named = nodes.select("node", "first").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    of = named.select("node", "label").join(named.groupBy("label").agg(F.min("first").alias("least")), "label").select("node", "least")
    full = rows.filter("node IS NOT NULL").join(of, "node").select("doc_id", "mark", "n", "node", "least")
    alone = rows.filter("node IS NULL").select("doc_id", "mark", "n", "node", F.lit(None).cast(full.schema["least"].dataType).alias("least"))
    return full.unionAll(alone)


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    component = F.when(F.col("least").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id"))
    out = _grouped(docs, width, percent).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group, the smallest doc_id; columns of docs."""
    rows = written(_grouped(docs, width, percent), "grouped")
    chosen = F.col("least").isNull() | (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("mark") == F.col("least.mark")))
    stays = rows.filter(chosen).groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).agg(F.max(F.col("least").isNotNull()).alias("_one"), F.count("*").alias("_n"))
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"))
    kept = own.join(stays, (F.col("mark") == F.col("_mark")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    if stays.filter("_one AND _n > 1").isEmpty():
        return kept.select("row.*")
    return kept.filter("_one").dropDuplicates(["_id", "_mark"]).unionAll(kept.filter("NOT _one")).select("row.*")
