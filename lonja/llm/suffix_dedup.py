"""Repeated passages by a depth-limited radix sort of suffixes.

Suffixes are ordered only through the first `depth` bytes; equal groups are exactly the repeated windows.
The sort goes by most significant digit and drops a group as soon as it cannot hold two documents:

1. Whole copies of a text fall together first; one of them, the smallest doc_id, is looked at.
2. First pass. Of the 16-byte grams inside a window the one with the least hash is the window's digit.
   Equal windows have equal digits, and neighbouring windows mostly share one, so a row stands for a run
   of about 18 windows. Digits that a single document has are dropped.
3. Later passes. Only the runs left carry their bytes. Equal runs fall together; the windows of the
   distinct ones are split digit by digit (eight bytes at a time, up to `depth`), each pass keeping only
   groups that still have two members. What is left at full depth are the repeated windows, each with the
   smallest doc_id that has it. The windows of a digit with more than LARGE bytes of distinct runs are
   grouped by their bytes in Spark instead, with minima formed before the shuffle.
4. A document loses every byte that a window with a smaller doc_id covers.

Defined results: null and empty text have no windows. Copies of a text in larger doc_ids lose all of it if
it has `depth` bytes or more. Rows that repeat a doc_id with one text are treated alike; rows that share a
doc_id do not count as each other's smaller. Rows with a null doc_id keep everything and take nothing from
others. Further columns are ignored. No rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonja.llm.common import discarded, whole, written

DEPTH, GRAM = 50, 16
_U = np.uint64
_FEW = 1 << 21  # bytes or rows handled at once inside a task
_CHUNK = 1 << 16  # bytes of short texts looked at together: fewer than 2 ** 15 of them
LARGE = 1 << 22  # bytes of contexts: a digit with more is not refined in one task


def eights(b: np.ndarray) -> np.ndarray:
    """The eight bytes from each place, as one number."""
    a = b.astype(_U)
    for step in (1, 2, 4):
        a = a[:-step] | (a[step:] << _U(8 * step))
    return a


def digits(text: bytes, depth: int = DEPTH, gram: int = GRAM) -> np.ndarray:
    """The first digit of each window: the least 48-bit hash of a gram inside it."""
    if len(text) < depth:
        return np.zeros(0, _U)
    a, n = eights(np.frombuffer(text, np.uint8)), len(text) - gram + 1
    h = np.zeros(n, _U)
    for at in sorted({*range(0, gram - 7, 8), gram - 8}):
        h = (h ^ a[at : at + n]) * _U(0x9E3779B97F4A7C15)
        h ^= h >> _U(29)
    h = (h * _U(0xC2B2AE3D27D4EB4F)) >> _U(16)
    width, step = depth - gram + 1, 1
    while 2 * step <= width:
        h, step = np.minimum(h[:-step], h[step:]), 2 * step
    return np.minimum(h[: len(h) - (width - step)], h[width - step :]) if step < width else h


def runs_of(texts: list[bytes], depth: int = DEPTH) -> Iterator[tuple[np.ndarray, ...]]:
    """Some texts' numbers, and of their runs (which of these texts, digit, first window, number of windows): short ones are looked at together."""
    own = [i for i, t in enumerate(texts) if len(t) >= depth]
    size = np.array([len(texts[i]) for i in own], np.int64)
    chunk = np.cumsum(size) // _CHUNK
    for part in np.split(np.arange(len(own)), np.flatnonzero(np.diff(chunk)) + 1) if own else ():
        d, n = digits(b"".join([texts[own[i]] for i in part]), depth), size[part]
        begin = np.cumsum(n) - n
        of = np.repeat(np.arange(len(part)), n)[: len(d)]
        end = (begin + n - depth + 1)[of]  # windows that reach into the next text are none
        new = np.append(True, d[1:] != d[:-1])
        new[begin] = True
        first = np.flatnonzero(new)
        stop = np.minimum(np.append(first[1:], len(d)), end[first])
        first, stop = first[some := first < stop], stop[some]
        yield np.asarray(own)[part], of[first], d[first].astype(np.int64), first - begin[of[first]], stop - first


def together(key: np.ndarray, digit: np.ndarray) -> np.ndarray:
    """An order in which rows of equal key and digit are neighbours."""
    mixed = digit * _U(0x9E3779B97F4A7C15) + key.astype(_U)
    order = np.argsort(mixed)
    m, k, g = mixed[order], key[order], digit[order]
    if ((m[1:] == m[:-1]) & ((k[1:] != k[:-1]) | (g[1:] != g[:-1]))).any():  # two pairs with one number
        return np.lexsort((digit, key))
    return order


def refine(group: np.ndarray, contexts: list[bytes], owner: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The smallest owner of each window of all contexts among contexts of its group, the window's context, and each context's first window."""
    size = np.array([len(c) - depth + 1 for c in contexts])
    starts = np.cumsum([0, *map(len, contexts[:-1])])
    a = eights(np.frombuffer(b"".join(contexts) + bytes(8), np.uint8))
    of = np.repeat(np.arange(len(contexts)), size)
    begin = np.cumsum(np.append(0, size[:-1]))
    place = starts[of] + np.arange(size.sum()) - begin[of]
    least = owner[of].copy()
    live = np.flatnonzero((np.bincount(group) > 1)[group][of])  # a context alone in its group meets no other owner
    key = group[of[live]]
    for at in [*range(0, depth - 7, 8), *([depth - 8] if depth % 8 else [])]:  # the digits below the first
        if not len(live):
            break
        digit = a[place[live] + at]
        order = together(key, digit)
        k, g = key[order], digit[order]
        new = np.append(True, (k[1:] != k[:-1]) | (g[1:] != g[:-1]))
        number = np.cumsum(new) - 1
        several = np.bincount(number)[number] > 1
        live, key = live[order[several]], number[several]
    if len(live):
        order = np.argsort(key, kind="stable")
        live, key = live[order], key[order]
        cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        least[live] = np.repeat(np.minimum.reduceat(owner[of[live]], cut), np.diff(np.append(cut, len(key))))
    return least, of, begin


def spans_of(least: np.ndarray, of: np.ndarray, begin: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Stretches of one owner in each context, as three 64-bit numbers each (first window, the one behind the last, owner), the
    number of the first stretch of each context with the number of all behind them, and the stretches' owners."""
    new = np.append(True, least[1:] != least[:-1])
    new[begin] = True
    cut = np.flatnonzero(new)
    stop = np.append(cut[1:], len(least))
    shift = begin[of[cut]]
    spans = np.stack([cut - shift, stop - shift, least[cut]], axis=1).astype("<i8").tobytes()
    return spans, np.append(np.searchsorted(cut, begin), len(cut)), least[cut]


def _parts(batches: Iterator[pd.DataFrame], weigh: str) -> Iterator[pd.DataFrame]:
    """Batches cut so that the texts of a part have about _FEW bytes."""
    for pdf in batches:
        ends = np.cumsum(pdf[weigh].map(len)) // _FEW
        for _, part in pdf.groupby(ends.to_numpy(), sort=False):
            yield part


def _first_pass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in _parts(batches, "text"):
        doc_id, v = pdf["doc_id"].to_numpy(), pdf["v"].to_numpy()
        for number, of, digit, *_ in runs_of([bytes(t) for t in pdf["text"]]):
            once = np.unique(of << 48 | digit)  # digits have 48 bits, and few texts are looked at together
            text = number[once >> 48]
            yield pd.DataFrame({"digit": once & ((1 << 48) - 1), "doc_id": doc_id[text], "v": v[text]})


def _with_bytes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in _parts(batches, "text"):
        doc_id, v, texts, shared = pdf["doc_id"].to_numpy(), pdf["v"].to_numpy(), [bytes(t) for t in pdf["text"]], pdf["digits"].to_numpy()
        for number, of, digit, first, n in runs_of(texts):
            wanted = np.concatenate([np.asarray(shared[i], np.int64) | at << 48 for at, i in enumerate(number)])
            found = np.flatnonzero(np.isin(of << 48 | digit, wanted))
            text, first, stop = number[of[found]], first[found], (first + n)[found] + DEPTH - 1
            contexts = [texts[i][a:b] for i, a, b in zip(text.tolist(), first.tolist(), stop.tolist())]
            yield pd.DataFrame({"digit": digit[found], "context": contexts, "doc_id": doc_id[text], "v": v[text], "start": first})


def _later_passes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by digit; whole groups are refined together, many small ones at a time."""

    def done(pdf: pd.DataFrame) -> pd.DataFrame:
        contexts, own, n = [bytes(c) for c in pdf["context"]], pdf["least"].to_numpy(), pdf["n"].to_numpy()
        least, of, begin = refine(pd.factorize(pdf["digit"])[0], contexts, own)
        spans, at, taken = spans_of(least, of, begin)
        kept = np.flatnonzero((n > 1) | np.logical_or.reduceat(taken != np.repeat(own, np.diff(at)), at[:-1]))
        return pd.DataFrame({"digit": pdf["digit"].to_numpy()[kept], "mark": pdf["mark"].to_numpy()[kept], "spans": [spans[i:j] for i, j in zip((at[kept] * 24).tolist(), (at[kept + 1] * 24).tolist())]})

    held: list[pd.DataFrame] = []
    for pdf in batches:
        last = pdf["digit"].iloc[-1] if len(pdf) else None
        ready = pdf[pdf["digit"] != last]
        if len(ready):
            yield done(pd.concat([*held, ready]))
            held = []
        held.append(pdf[pdf["digit"] == last])
    if held and len(rest := pd.concat(held)):
        yield done(rest)


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every window of every context with its place, some at a time."""
    most = _FEW // DEPTH
    for pdf in batches:
        for digit, mark, least, c in zip(pdf["digit"], pdf["mark"], pdf["least"], map(bytes, pdf["context"])):
            for a in range(0, len(c) - DEPTH + 1, most):
                places = range(a, min(a + most, len(c) - DEPTH + 1))
                yield pd.DataFrame({"digit": digit, "mark": mark, "least": least, "place": places, "window": [c[i : i + DEPTH] for i in places]})


def _as_spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for digit, mark, own, size, found in zip(pdf["digit"], pdf["mark"], pdf["least"], pdf["size"], pdf["found"]):
            m = np.full(size, own, np.int64)
            for place, low in () if found is None else ((x["place"], x["lo"]) for x in found):
                m[place] = low
            cut = np.flatnonzero(np.append(True, m[1:] != m[:-1]))
            out.append((digit, mark, np.stack([cut, np.append(cut[1:], size), m[cut]], axis=1).astype("<i8").tobytes()))
        yield pd.DataFrame(out, columns=["digit", "mark", "spans"])


def spread_spans(large: DataFrame) -> DataFrame:
    """digit, mark, spans as `_later_passes` gives them, for digits of any size: no group has to fit into a task."""
    windows = large.select("digit", "mark", "least", "context").mapInPandas(_windows, "digit long, mark long, least long, place int, window binary")
    windows = written(windows, "windows")
    lowest = windows.groupBy("window").agg(F.min("least").alias("lo"), F.max("least").alias("hi")).filter("lo < hi").select("window", "lo")
    lower = windows.join(lowest, "window").filter("lo < least").groupBy("digit", "mark").agg(F.collect_list(F.struct("place", "lo")).alias("found"))
    sized = large.select("digit", "mark", "least", "n", (F.octet_length("context") - (DEPTH - 1)).alias("size"))
    some = sized.join(lower, ["digit", "mark"], "left").filter("n > 1 OR found IS NOT NULL")
    spans = written(some.select("digit", "mark", "least", "size", "found").mapInPandas(_as_spans, "digit long, mark long, spans binary"), "spread-spans")
    discarded(windows)
    return spans


def _intervals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        spans = np.frombuffer(b"".join(map(bytes, pdf["spans"])), "<i8").reshape(-1, 3)
        of = np.repeat(np.arange(len(pdf)), pdf["spans"].map(len).to_numpy(np.int64) // 24)
        lower = np.flatnonzero(spans[:, 2] < pdf["doc_id"].to_numpy()[of])
        of, spans = of[lower], spans[lower]
        start = pdf["start"].to_numpy(np.int64)[of]
        yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[of], "v": pdf["v"].to_numpy()[of], "a": start + spans[:, 0], "b": start + spans[:, 1] - 1 + DEPTH})


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals [a, b) as maximal runs; those that touch are one."""
    order = np.argsort(a, kind="stable")
    a, reach = a[order], np.maximum.accumulate(b[order])
    cut = np.flatnonzero(np.append(True, a[1:] > reach[:-1]))
    return a[cut], reach[np.append(cut[1:], len(a)) - 1]


def kept_pieces(text: bytes, a: np.ndarray, b: np.ndarray) -> bytes:
    return b"".join(text[i:j] for i, j in zip([0, *b.tolist()], [*a.tolist(), len(text)]))


def _removed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for doc_id, text, a, b in zip(pdf["doc_id"], map(bytes, pdf["text"]), pdf["a"], pdf["b"]):
            a, b = merged(np.asarray(a), np.asarray(b))
            out.append((doc_id, hashlib.sha256(text).hexdigest(), int((b - a).sum()), len(a), hashlib.sha256(kept_pieces(text, a, b)).hexdigest()))
        yield pd.DataFrame(out, columns=["doc_id", "sha", "n_removed", "n_spans", "kept_sha256"])


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs."""
    own = docs.select("doc_id", whole().cast("binary").alias("text"))
    own = own.withColumns({"sha": F.sha2("text", 256), "v": F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")})
    rows = written(own.select("doc_id", "sha", "v", F.octet_length("text").cast("long").alias("n_bytes")), "texts")
    first = rows.groupBy("sha", "v").agg(F.min("doc_id").alias("first_id"), F.max("n_bytes").alias("n"))
    looked_at = written(first.filter(F.col("first_id").isNotNull() & (F.col("n") >= DEPTH)).select(F.col("first_id").alias("doc_id"), "v"), "looked-at")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select("doc_id", whole().cast("binary").alias("text")).filter("doc_id IS NOT NULL").withColumn("v", F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    texts = texts.repartition(parts, "doc_id", "v").join(looked_at, ["doc_id", "v"], "left_semi")

    # Tables, so that the pass runs once and no two of its shuffles lie on disk at a time.
    digit_rows = written(texts.select("doc_id", "v", "text").mapInPandas(_first_pass, "digit long, doc_id long, v int"), "digit-rows")
    ends = digit_rows.groupBy("digit").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi")
    ends = written(ends.select("digit"), "shared-digits")
    lists = written(digit_rows.join(ends, "digit", "left_semi").groupBy("doc_id", "v").agg(F.collect_list("digit").alias("digits")), "digits")
    discarded(digit_rows)
    discarded(ends)

    carried = texts.join(lists, ["doc_id", "v"]).select("doc_id", "v", "text", "digits").mapInPandas(_with_bytes, "digit long, context binary, doc_id long, v int, start int")
    carried = kept_runs = written(carried, "runs")
    discarded(lists)
    # Within a digit, 64 more bits name a run's bytes where only equality counts.
    carried = carried.withColumn("mark", F.xxhash64("context"))
    distinct = written(carried.groupBy("digit", "mark", "context").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    # One row per LARGE bytes at most; Spark broadcasts it only below its own size limit.
    large = distinct.groupBy("digit").agg(F.sum(F.octet_length("context")).alias("bytes")).filter(F.col("bytes") > LARGE).select("digit")
    large = written(large, "large")
    some_large = bool(large.take(1))
    small = distinct.join(large, "digit", "left_anti") if some_large else distinct
    spans = small.repartition(parts, "digit").sortWithinPartitions("digit").mapInPandas(_later_passes, "digit long, mark long, spans binary")
    spans = kept_spans = written(spans, "spans")
    if some_large:
        spans = spans.unionByName(spread_spans(distinct.join(large, "digit", "left_semi")))
    discarded(distinct)
    found = carried.drop("context").join(spans, ["digit", "mark"]).select("doc_id", "v", "start", "spans").mapInPandas(_intervals, "doc_id long, v int, a long, b long")
    found = written(found.groupBy("doc_id", "v").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b")), "intervals")
    discarded(kept_runs)
    discarded(kept_spans)
    cut = texts.join(found, ["doc_id", "v"]).select("doc_id", "text", "a", "b").mapInPandas(_removed, "doc_id long, sha string, n_removed long, n_spans long, kept_sha256 string")
    cut = cut.dropDuplicates(["doc_id", "sha"]).select("doc_id", "sha", "n_removed", "n_spans", F.col("kept_sha256").alias("rest"))

    copy = (F.col("doc_id") > F.col("first_id")) & (F.col("n_bytes") >= DEPTH)
    marked = rows.join(first.select("sha", "v", "first_id"), ["sha", "v"]).withColumn("copy", F.coalesce(copy, F.lit(False)))
    return marked.join(cut, ["doc_id", "sha"], "left").select(
        "doc_id",
        "n_bytes",
        F.when(F.col("copy"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("copy"), F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("rest", "sha")).alias("kept_sha256"),
    )
