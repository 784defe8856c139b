"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; everything else in the training folds is unlabelled. A
linear classifier over hashed words and word stems (those significantly more frequent among the
positives than in all documents, which takes no negative label) is fitted with numpy by the class-prior-corrected risk

    prior * E_P[loss(f, +)] + max(0, E_U[loss(f, -)] - prior * E_P[loss(f, -)])

where a negative second part is stepped back instead of followed. The class prior is the share of toxic
rows among the labels of the training folds. A one-dimensional logistic fit on those labels turns f into a
probability, laid so that 0.3 is the cut that best separates them.

Which slots count is decided from document frequencies over all training documents and all confirmed toxic
ones. E_U runs over every training document and E_P over every confirmed toxic one: documents with the same
telling slots are one row with counts. Rows with up to `most_entries` slots in all are fitted on the driver, more by sums over
blocks in the executors, step by step with the same result. The cut is taken from all labels of the training folds in
either case, in executors by running sums over ranges of f. What reaches the driver at once is those rows, the
frequencies of slots (2 ** BITS at most) and the gradient. Scoring runs over every whole text with a weight
vector of fixed size.

Labelled negatives serve two numbers only, the class prior and the place of the cut; weights come from
positives and unlabelled rows alone.

Folds are held out for measuring the model, as op2's query does. With `held` None nothing is: all documents, those
without a doc_id among them, and all labels are what is called training here, as in the pipeline.

Defined results: null text counts as empty; a very long text is one bag of its distinct slots, read whole; a text without words gets the score of the bias, and with no
toxic label to learn from every score is 0; with labels but no word that tells toxic texts from others,
none is rejected. Rows that repeat are scored each; of labels that repeat a
doc_id the largest counts. Null doc_id is in no fold: never held out, learnt from only where nothing is, as unlabelled;
a label without doc_id never counts. Further columns may have any name; `keep_clean` returns them as they are. No rows give no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonja.llm.common import discarded, written

BITS, CUT, MEMO, STEMS = 20, 0.3, 300_000, (4, 5, 6, 7)
BUCKETS = 1 << 18
FEW = 1 << 20  # slots held at once while counting
_WORD = re.compile(r"[^\W\d_]+")


class WordSlots(dict):
    """word -> hash slots of the word and of its stems (first letters), memoised up to a bound; those with a weight, if weights are given."""

    def __init__(self, weights: np.ndarray | None = None):
        self.weights = weights

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= MEMO:
            self.clear()
        parts = [word, *(f"{word[:n]}-" for n in STEMS if len(word) > n)]
        slots = tuple(zlib.crc32(p.encode("utf-8", "replace")) & ((1 << BITS) - 1) for p in parts)
        self[word] = slots = slots if self.weights is None else tuple(s for s in slots if self.weights[s])
        return slots


def slots_of(text: str, memo: WordSlots) -> np.ndarray:
    """The distinct slots of a whole text's words."""
    return np.unique(np.fromiter(chain.from_iterable(map(memo.__getitem__, set(_WORD.findall(text.lower())))), dtype=np.int64))


def enriched(among: np.ndarray, frequency: np.ndarray, toxic: int, every: int, z: float = 4.0, least: int = 3, lift: float = 2.0) -> np.ndarray:
    """Whether a slot is in significantly more of the toxic documents, and `lift` times as many at least, than their number and its overall frequency explain.

    Significance alone would take in ever weaker slots as documents grow.
    """
    rate = (frequency + 0.5) / (every + 1)
    return (among >= least) & (among >= lift * toxic * rate) & (among - toxic * rate > z * np.sqrt(toxic * rate * (1 - rate)))


def block(bags: list[np.ndarray], positive: np.ndarray, unlabelled: np.ndarray) -> tuple[np.ndarray, ...]:
    """Bags as flat arrays: slot and row of each entry, the two counts of each row, and the entries of rows with positives again."""
    idx, row = np.concatenate([np.zeros(0, np.int64), *bags]), np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    p = np.asarray(positive, float)
    own = p[row] > 0
    return idx, row, p, np.asarray(unlabelled, float), idx[own], row[own]


def risk_sums(part: tuple[np.ndarray, ...], w: np.ndarray, b: float) -> np.ndarray:
    """Over a block, for positives as such, positives by their slope and unlabelled by their slope: the gradient with the bias last; then both losses as negative."""
    idx, row, p, u, own_idx, own_row = part
    f = np.bincount(row, w[idx], minlength=len(p)) + b
    s = 1 / (1 + np.exp(-np.clip(f, -30, 30)))  # slope of the loss as negative; as positive it is s - 1
    soft = np.logaddexp(0, f)
    each = [np.append(np.bincount(i, g[r], minlength=len(w)), g.sum()) for i, r, g in ((own_idx, own_row, p), (own_idx, own_row, p * s), (idx, row, u * s))]
    return np.concatenate([*each, [(p * soft).sum(), (u * soft).sum()]])


def fit_nnpu(sums: Callable[[np.ndarray, float], np.ndarray], d: int, n_p: float, n_u: float, prior: float, steps: int = 250, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """d weights and the bias; `sums` gives `risk_sums` over all rows."""
    w, b = np.zeros(d), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    for t in range(1, steps + 1):
        *got, soft_p, soft_u = np.split(sums(w, b), [d + 1, 2 * d + 2, 3 * d + 3, 3 * d + 4])
        p, ps, us = got[0] / max(1, n_p), got[1] / max(1, n_p), got[2] / max(1, n_u)
        rest = soft_u[0] / max(1, n_u) - prior * soft_p[0] / max(1, n_p)
        grad = us - prior * p if rest >= 0 else prior * ps - us
        grad[:-1] += decay * w * (rest >= 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def calibrated(f: np.ndarray, toxic: np.ndarray, known: np.ndarray) -> tuple[float, float]:
    """(scale, cut): score = sigmoid(scale * (f - cut) + logit(0.3)), the cut of best F1 half way to the next lower value.

    A row stands for `known` labels, `toxic` of them toxic. Values that are all alike separate nothing: no score reaches 0.3 then.
    """
    if not len(f) or not toxic.any() or f.min() == f.max():
        return 1.0, float(f.max(initial=0.0)) + 20.0
    order = np.argsort(-f, kind="stable")
    hit, ranks = np.cumsum(toxic[order]), np.cumsum(known[order])
    f1 = 2 * hit / (ranks + toxic.sum())
    f1[:-1][f[order][:-1] == f[order][1:]] = -1  # a cut never falls between equal values
    best = int(np.argmax(f1))
    after = f[order][best + 1] if best + 1 < len(f) else f[order][best] - 1.0
    cut = float((f[order][best] + after) / 2)
    spread = np.sqrt(np.average((f - np.average(f, weights=known)) ** 2, weights=known))
    return float(np.clip(4.0 / (spread + 1e-6), 0.2, 5.0)), cut


def spread_calibrated(scored: DataFrame) -> tuple[float, float]:
    """`calibrated` of a table (f, p, known) of any size, whole: p of the `known` labels of a row are toxic."""
    from lonja.operators.ordering import with_running  # not for the workers, which import this module too

    values = written(scored.groupBy("f").agg(F.sum("p").alias("p"), F.sum("known").alias("known")), "values")
    every = values.agg(F.sum("p").alias("p"), F.sum("known").alias("known"), F.max("f").alias("most"), F.min("f").alias("least"), F.sum(F.col("known") * F.col("f")).alias("f")).first()
    if not every.p or every.most == every.least:
        discarded(values)
        return 1.0, max(0.0, every.most or 0.0) + 20.0
    ranked = with_running(values, [F.desc("f")], {"hit": F.col("p"), "ranks": F.col("known")})
    best = ranked.orderBy(F.desc(2 * F.col("hit") / (F.col("ranks") + every.p)), F.desc("f")).first().f
    discarded(ranked)
    mean = every.f / every.known
    after = F.max(F.when(F.col("f") < best, F.col("f"))).alias("after")
    rest = values.agg(after, F.sum(F.col("known") * (F.col("f") - mean) * (F.col("f") - mean)).alias("squares")).first()
    discarded(values)
    spread = np.sqrt(rest.squares / every.known)
    return float(np.clip(4.0 / (spread + 1e-6), 0.2, 5.0)), (best + (best - 1.0 if rest.after is None else rest.after)) / 2


def fold(of: str, parts: int):
    return F.pmod(F.crc32(F.col(of).cast("string").cast("binary")), F.lit(parts))


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a task's documents and of the toxic ones among them, how many have each slot; slot -1 counts them all."""
    memo, held = WordSlots(), 0
    every, toxic, parts = np.zeros((1 << BITS) + 1, np.int64), np.zeros((1 << BITS) + 1, np.int64), ([], [])

    def count() -> None:
        for total, bags in zip((every, toxic), parts):
            if bags:
                total[:-1] += np.bincount(np.concatenate(bags), minlength=1 << BITS)
                total[-1] += len(bags)
                bags.clear()

    for pdf in batches:
        for text, is_toxic in zip(pdf["text"], pdf["toxic"]):
            bag = slots_of(text or "", memo)
            parts[0].append(bag)
            if is_toxic:
                parts[1].append(bag)
            if (held := held + len(bag) + 1) > FEW:
                count()
                held = 0
    count()
    slot = np.append(np.flatnonzero(every[:-1]), 1 << BITS)
    yield pd.DataFrame({"slot": np.where(slot == 1 << BITS, -1, slot), "n": every[slot], "p": toxic[slot]})


def of_ids(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of some doc_ids. Rows whose id has another hash than all of these leave before the shuffle; the hashes
    are BUCKETS at most, so they can be sent to all tasks whatever the number of ids."""
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).alias("bucket")
    near = texts.withColumn("bucket", bucket).join(F.broadcast(ids.select(bucket).distinct()), "bucket", "left_semi")
    return near.drop("bucket").join(ids.select("doc_id"), "doc_id", "left_semi")


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        parts = block([np.frombuffer(x, "<i4").astype(np.int64) for x in pdf["bag"]], pdf["p"].to_numpy(), pdf["u"].to_numpy())
        yield pd.DataFrame([[x.tobytes() for x in parts]], columns=["idx", "row", "p", "u", "own_idx", "own_row"])


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a + b


def spread_sums(rows: DataFrame) -> tuple[Callable[[np.ndarray, float], np.ndarray], Callable[[], None]]:
    """`risk_sums` over a table of bags with counts, added up in the executors, and what frees its blocks."""
    types = (np.int64, np.int64, float, float, np.int64, np.int64)
    parts = rows.select("bag", "p", "u").mapInPandas(_blocks, "idx binary, row binary, p binary, u binary, own_idx binary, own_row binary").rdd
    parts = parts.map(lambda r: tuple(np.frombuffer(x, t) for x, t in zip(r, types))).persist(StorageLevel.MEMORY_AND_DISK)

    def sums(w: np.ndarray, b: float) -> np.ndarray:
        shared = parts.context.broadcast((w, b))
        try:
            return parts.map(lambda x: risk_sums(x, *shared.value)).treeReduce(_add)
        finally:
            shared.destroy()

    return sums, parts.unpersist


def learn(docs: DataFrame, labels: DataFrame, most_entries: int = 8_000_000, parts: int = 4, held: int | None = 2):
    """(weights, bias, scale, cut) from the folds that are not held out, from all rows if held is None; None if no label is toxic there."""
    folds = F.lit(True) if held is None else F.coalesce(fold("doc_id", parts) != held, F.lit(False))
    own = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & folds).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = own.agg(F.count("*").alias("n"), F.sum(F.col("toxic").cast("long")).alias("p")).first()
    if not counts.p:
        return None
    prior = counts.p / counts.n
    texts = docs.filter(folds).select("doc_id", "text")
    often = lambda df, toxic: df.select("text", F.lit(toxic).alias("toxic")).mapInPandas(_frequencies, "slot int, n long, p long")
    toxic = often(of_ids(texts, own.filter("toxic = 1")), True).withColumn("n", F.lit(0).cast("long"))
    seen = often(texts, False).unionByName(toxic).groupBy("slot").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    seen = seen.filter("slot < 0 OR p > 0").toPandas().sort_values("slot")
    if not len(seen) or not seen["p"].iloc[0]:
        return None
    every, toxic, seen = int(seen["n"].iloc[0]), int(seen["p"].iloc[0]), seen.iloc[1:]
    telling = seen["slot"].to_numpy()[enriched(seen["p"].to_numpy(), seen["n"].to_numpy(), toxic, every)]
    place = np.full(1 << BITS, -1, np.int32)
    place[telling] = np.arange(len(telling))
    shared = docs.sparkSession.sparkContext.broadcast(place)

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = shared.value
        memo = WordSlots(at >= 0)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "bag": [np.sort(at[slots_of(t or "", memo)]).astype("<i4").tobytes() for t in pdf["text"]]})

    rows = texts.mapInPandas(bags, "doc_id long, bag binary").join(own, "doc_id", "left")
    rows = rows.groupBy("bag").agg(F.count("*").alias("u"), F.count("toxic").alias("known"), F.count(F.when(F.col("toxic") == 1, 1)).alias("p"))
    rows = written(rows, "bags")
    as_bags = lambda column: [np.frombuffer(x, "<i4").astype(np.int64) for x in column]
    values = lambda column, w, b: np.array([w[s].sum() + b for s in as_bags(column)])
    if (rows.agg(F.sum(F.octet_length("bag"))).first()[0] or 0) // 4 <= most_entries:
        got = rows.toPandas().sort_values("bag", kind="stable")
        whole_table = block(as_bags(got["bag"]), got["p"].to_numpy(), got["u"].to_numpy())
        w, b = fit_nnpu(lambda w, b: risk_sums(whole_table, w, b), len(telling), toxic, every, prior)
        got = got[got["known"] > 0]
        laid = calibrated(values(got["bag"], w, b), got["p"].to_numpy(float), got["known"].to_numpy(float))
    else:
        sums, free = spread_sums(rows)
        w, b = fit_nnpu(sums, len(telling), toxic, every, prior)
        free()

        def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame({"f": values(pdf["bag"], w, b), "p": pdf["p"], "known": pdf["known"]})

        laid = spread_calibrated(rows.filter("known > 0").select("bag", "p", "known").mapInPandas(scored, "f double, p long, known long"))
    discarded(rows)
    weights = np.zeros(1 << BITS, np.float32)
    weights[telling] = w
    return weights, b, *laid


def score(docs: DataFrame, model, parts: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    base = docs.select("doc_id", F.coalesce(fold("doc_id", parts) == held, F.lit(False)).alias("held_out"), "text")
    schema = "doc_id long, held_out boolean, score double, predicted int"
    if model is None:
        return base.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS weights, whatever the input

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, b, scale, cut = shared.value
        memo = WordSlots(w)
        base_logit = np.log(CUT / (1 - CUT))
        for pdf in batches:
            f = np.array([w[slots_of(t or "", memo)].sum(dtype=np.float64) + b for t in pdf["text"]])
            s = 1 / (1 + np.exp(-np.clip(scale * (f - cut) + base_logit, -40, 40)))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": s, "predicted": (s >= CUT).astype("int32")})

    return base.mapInPandas(run, schema)


def keep_clean(docs: DataFrame, model) -> DataFrame:
    """docs without those scored toxic, in one pass over the texts, with the columns of docs."""
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w, b, _, cut = shared.value
        memo = WordSlots(w)
        for t in texts:
            yield pd.Series([bool(w[slots_of(x or "", memo)].sum(dtype=np.float64) + b < cut) for x in t], dtype=bool)

    return docs.filter(F.pandas_udf(run, "boolean")(F.col("text")))
