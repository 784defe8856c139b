"""Mixing sources to target weights by Sainte-Lague apportionment.

A source's target is its share, by weight, of all words; a target stops at `most` times the source's size
and what is over goes to the others by weight. Targets are then turned into whole blocks of equal numbers
of words by highest quotients (weight over 1, 3, 5, ...): first among sources, then among the shards of a
source, which gives each shard an integer quota of blocks. A block has BLOCK words, fewer only where the
sources have under 200 blocks each on average; the size of a single source plays no part. Inside a shard the documents stand in a seeded
order, as one stream cut into blocks. A quota above the stream is met by whole repeats; the rest by blocks
spread evenly through the stream from a seeded start. How many chosen blocks a document has part in is
counted in closed form, so blocks are never rows.

The driver sees one row per source (the number of sources is taken to be moderate, as weights are set for
each by hand) and nothing that grows with the documents. A shard holds about `rows_per_shard` documents of
one source, so a hot source has many shards and a small one few.

Defined results: null or empty text has size 0 and is never taken; the null source is a source of its own,
last in order; rows that repeat are separate documents. A very long text spans many blocks, which are
counted, not listed. If there are no words, every target is 0. The same input gives the same result. No
rows give no rows. Further columns may have any name; `mixed` carries them along as one struct.
"""

from __future__ import annotations

import json
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lonja.llm.common import words_in, written

WEIGHTS, BLOCK = (5, 2, 1), 128
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """Shares of sum(sizes) by weight, none above most times its size; the excess is reshared until none is."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        each = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if weights[i] * each > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = weights[i] * each
            break
        for i in over:
            out[i] = most * sizes[i]
            left -= out[i]
            open_.discard(i)
    return out


def sainte_lague(weights, seats: int, cap=None) -> np.ndarray:
    """Seats by highest quotients weight / (2 n + 1); ties go to the earlier one; none gets more than its cap."""
    w = np.asarray(weights, dtype=np.float64)
    cap = np.full(len(w), np.iinfo(np.int64).max // 4) if cap is None else np.asarray(cap, dtype=np.int64)
    seats = int(min(seats, cap[w > 0].sum())) if (w > 0).any() else 0
    got = np.zeros(len(w), dtype=np.int64)
    if seats <= 0:
        return got

    def at(d: float) -> np.ndarray:  # seats whose quotient is above d / 2
        return np.where(w > 0, np.minimum(np.floor(w / d + 0.5), cap), 0).astype(np.int64)

    low, high = 0.0, 2.5 * float(w.max())
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        if at(mid).sum() > seats:
            low = mid
        else:
            high = mid
    got = at(high)
    while (more := seats - int(got.sum())) > 0:  # the last few seats one by one
        q = np.where((w > 0) & (got < cap), w / (2 * got + 1), -1.0)
        for i in np.argsort(-q, kind="stable")[: max(1, min(more, 1 if more < 8 else more // 4))]:
            if q[i] > 0:
                got[i] += 1
    return got


def _planned(base: DataFrame, weights, most: int, seed: int, rows_per_shard: int, max_shards: int) -> DataFrame:
    """base (with columns doc_id, source, size) with what the plan says of each row's place in its shard's stream."""
    label = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
    base = base.withColumns({"label": label, "turn": F.xxhash64(F.lit(seed), "doc_id", "size")})
    found = base.groupBy("label").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()  # one row a source
    found.sort(key=lambda r: (r["label"] == "n", r["label"]))
    sizes = [int(r["size"]) for r in found]
    aims = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], most)
    block = max(1, min(BLOCK, sum(sizes) // (200 * max(1, sum(s > 0 for s in sizes)))))
    quota = sainte_lague(aims, round(sum(aims) / block), [-(-most * s // block) for s in sizes])
    of = {r["label"]: (s, a, int(q)) for r, s, a, q in zip(found, sizes, aims, quota)}
    shards = F.from_json(F.lit(json.dumps({r["label"]: max(1, min(max_shards, -(-r["n"] // rows_per_shard))) for r in found})), "map<string,int>")

    def per_shard(pdf: pd.DataFrame) -> pd.DataFrame:  # one source: at most max_shards rows
        pdf = pdf.sort_values("shard", kind="stable")
        size, aim, q = of[pdf["label"].iloc[0]]
        n = -(-pdf["words"].to_numpy() // block)
        got = sainte_lague(n, min(most * int(n.sum()), round(q * block * int(n.sum()) / max(size, 1))) if aim < most * size else most * int(n.sum()), most * n)
        n = np.maximum(n, 1)
        return pdf.assign(source_size=size, target=aim, n=n, full=got // n, more=got % n)

    dealt = base.withColumn("shard", F.pmod(F.shiftright("turn", 20), F.element_at(shards, F.col("label"))).cast("int"))
    quotas = (
        dealt.groupBy("label", "shard").agg(F.sum("size").alias("words")).groupBy("label")
        .applyInPandas(per_shard, "label string, shard int, words long, source_size long, target double, n long, full long, more long")
    )
    stream = Window.partitionBy("label", "shard").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    phase = F.pmod(F.xxhash64(F.lit(seed), "label", "shard"), F.lit(1 << 20)) / float(1 << 20)
    return (
        dealt.join(quotas.drop("words"), ["label", "shard"])
        .withColumns({"end": F.sum("size").over(stream), "phase": phase, "block": F.lit(block).cast("long")})
        .withColumn("start", F.col("end") - F.col("size"))
    )


def _part_taken():
    """Words of a row in chosen blocks; block i is chosen where floor(i * more / n + phase) steps up after it."""
    b, i, j = F.col("block"), F.floor(F.col("start") / F.col("block")), F.floor((F.col("end") - 1) / F.col("block"))
    before = lambda i: F.floor(i * F.col("more") / F.col("n") + F.col("phase"))  # noqa: E731  blocks chosen among the first i
    part = lambda i, words: F.when(before(i + 1) > before(i), words).otherwise(0)
    several = part(i, (i + 1) * b - F.col("start")) + (before(j) - before(i + 1)) * b + part(j, F.col("end") - j * b)
    return F.when(F.col("size") == 0, 0).when(i == j, part(i, F.col("size"))).otherwise(several).cast("long")


def mix(docs: DataFrame, weights=WEIGHTS, most: int = 3, seed: int = 17, rows_per_shard: int = 256, max_shards: int = 4096) -> DataFrame:
    """doc_id, size, source_size, target, taken (and source, shard) for every row of docs."""
    base = written(docs.select("doc_id", "source", words_in().alias("size")), "sizes")
    taken = F.col("full") * F.col("size") + _part_taken()
    return _planned(base, weights, most, seed, rows_per_shard, max_shards).select(
        "doc_id", "size", "source_size", "target", taken.alias("taken"), "source", "shard"
    )


def chosen_text(text: str, start: int, block: int, more: int, n: int, phase: float) -> str:
    """The words of a text that lie in chosen blocks, each stretch with its own white space."""
    at = [m.span() for m in _WORDS.finditer(text)]
    before = lambda i: math.floor(i * more / n + phase)
    out = []
    for i in range(start // block, (start + len(at) - 1) // block + 1):
        if before(i + 1) > before(i):
            a, b = max(0, i * block - start), min(len(at), (i + 1) * block - start)
            if out and out[-1][1] == a:
                a = out.pop()[0]
            out.append((a, b))
    return "\n".join(text[at[a][0] : at[b - 1][1]] for a, b in out)


def mixed(docs: DataFrame, weights=WEIGHTS, most: int = 3, seed: int = 17, rows_per_shard: int = 256, max_shards: int = 4096) -> DataFrame:
    """The mix itself, with the columns of docs: whole repeats of a document, then the part in chosen blocks."""
    base = docs.select("doc_id", "source", words_in().alias("size"), F.struct("*").alias("row"))
    plan = _planned(base, weights, most, seed, rows_per_shard, max_shards).withColumn("part", _part_taken())

    @F.pandas_udf("string")
    def cut(text: pd.Series, start: pd.Series, block: pd.Series, more: pd.Series, n: pd.Series, phase: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else chosen_text(t, a, b, m, k, f) for t, a, b, m, k, f in zip(text, start, block, more, n, phase)], dtype=object)

    taken = plan.filter((F.col("size") > 0) & ((F.col("full") > 0) | (F.col("part") > 0)))
    copies = taken.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("full")))).filter("i < full OR part > 0")
    is_cut = (F.col("i") == F.col("full")) & (F.col("part") < F.col("size"))
    text = F.when(is_cut, cut(F.when(is_cut, F.col("row.text")), "start", "block", "more", "n", "phase")).otherwise(F.col("row.text"))
    out = copies.withColumn("text", text).withColumn("row", F.col("row").withField("text", F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("row", F.col("row").withField("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select("row.*")
