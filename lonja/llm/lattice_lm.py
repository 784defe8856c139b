"""Document scores from a subword lattice.

Pieces come from an existing subword vocabulary; none is trained. Of the public vocabularies installed the
only one of this kind is a merge vocabulary, whose scores are the negated order of its merges and no log
probabilities: they would give every piece a weight without meaning. So unigram scores are estimated from
the word counts of the training folds: each distinct word is segmented by the vocabulary's own encoder and
its pieces counted as often as the word. A word's probability is the sum over all its segmentations, by a
forward recursion in log space; a document's is the product over its words and an end symbol. Bytes are
pieces too, so every text has a probability.

Beside it stands a plain add-one word model. One table, as large as the corpus's vocabulary, holds each
distinct word once with its training count and its lattice probability. Words that make up at least
1 / `hot` of all training tokens and have at most `short` bytes are sent to the tasks (there can be no more
than `hot` of them, and so no more than hot * short bytes of words); all others are looked up by a join on
the word, documents first having been reduced to their distinct words.

Defined results: null and empty text are the end token alone; a very long text is reduced to its distinct
words in one task, a very long word goes through the recursion whole; rows that repeat are scored each. A null
doc_id is not held out and is learnt from. With no training rows every count is 0. Further columns are
ignored. No rows give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonja.llm.common import written

SPACE, LN10 = "▁", math.log(10)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def load_pieces(model: str) -> dict[str, int]:
    """piece -> id of the vocabulary's normal pieces that hold no inner space mark, and <0x..> for bytes."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    out = {}
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        if not (sp.is_unknown(i) or sp.is_control(i)) and (sp.is_byte(i) or SPACE not in p[1:]):
            out[p] = i
    return out


class Lattice:
    """Natural-log probability of a word summed over all segmentations; what a word shares with the one before it is not redone."""

    def __init__(self, logp: dict[str, float]):
        self.logp = {p: v for p, v in logp.items() if not p.startswith("<0x")}
        self.byte = [logp[f"<0x{b:02X}>"] for b in range(256)]
        self.longest = max(map(len, self.logp), default=1)
        self.chars: dict[str, float] = {}
        self.last, self.alpha = "", [0.0]

    def char(self, c: str) -> float:
        """A character by its bytes."""
        if (v := self.chars.get(c)) is None:
            v = self.chars[c] = sum(self.byte[b] for b in c.encode("utf-8", "surrogatepass"))
        return v

    def word(self, word: bytes) -> float:
        s, alpha = SPACE + word.decode("utf-8", "surrogatepass"), self.alpha
        same = 0
        for x, y in zip(s, self.last):
            if x != y:
                break
            same += 1
        del alpha[same + 1 :]
        self.last, get, longest = s, self.logp.get, self.longest
        for j in range(same + 1, len(s) + 1):
            terms = [alpha[j - 1] + self.char(s[j - 1])]
            for i in range(max(0, j - longest), j):
                if (p := get(s[i:j])) is not None:
                    terms.append(alpha[i] + p)
            if len(terms) > 1:
                top = max(terms)
                alpha.append(top + math.log(sum([math.exp(t - top) for t in terms])))
            else:
                alpha.append(terms[0])
        return alpha[-1]


def count_words(docs: DataFrame, parts: int = 7, held: int = 2) -> DataFrame:
    """(word, c): every distinct word of the whole texts and how often the training folds have it; batches are counted before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            c: Counter = Counter()
            others: set[bytes] = set()
            for t, held_ in zip(pdf["text"], pdf["held_out"]):
                if held_:
                    others.update(words_of(t))
                else:
                    c.update(words_of(t))
            others.difference_update(c)
            n = np.append(np.fromiter(c.values(), np.int64, len(c)), np.zeros(len(others), np.int64))
            yield pd.DataFrame({"word": [*c, *others], "c": n})

    return docs.select("text", held_out(parts, held).alias("held_out")).mapInPandas(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def held_out(parts: int = 7, held: int = 2):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts)) == held, F.lit(False))


def piece_scores(counts: DataFrame, model: str, ends: int) -> dict[str, float]:
    """Natural-log unigram score of each piece, and of the end symbol under ''; one row per piece reaches the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        total = np.zeros(sp.get_piece_size())
        for pdf in batches:
            ids = sp.encode([bytes(w).decode("utf-8", "replace") for w in pdf["word"]], num_threads=1)
            n = np.repeat(pdf["c"].to_numpy(dtype=float), list(map(len, ids)))
            total += np.bincount(np.fromiter(chain.from_iterable(ids), np.int64, len(n)), n, minlength=len(total))
        used = np.flatnonzero(total)
        yield pd.DataFrame({"id": used.astype(np.int32), "n": total[used]})

    got = {r["id"]: r["n"] for r in counts.filter("c > 0").mapInPandas(run, "id int, n double").groupBy("id").agg(F.sum("n").alias("n")).collect()}
    pieces = load_pieces(model)
    weight = {p: got.get(i, 0.0) + 0.5 for p, i in pieces.items()} | {"": ends + 0.5}
    total = math.log(sum(weight.values()))
    return {p: math.log(w) - total for p, w in weight.items()}


def word_scores(counts: DataFrame, logp: dict[str, float]) -> DataFrame:
    """(word, c, lp): counts with each word's lattice probability. Words come in order, so neighbours share their beginnings."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice = Lattice(logp)
        for pdf in batches:
            yield pd.DataFrame({"word": pdf["word"], "c": pdf["c"], "lp": [lattice.word(bytes(w)) for w in pdf["word"]]})

    return counts.sortWithinPartitions("word").mapInPandas(run, "word binary, c long, lp double")


def score(docs: DataFrame, model: str, parts: int = 7, held: int = 2, hot: int = 400_000, short: int = 64) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs."""
    sc = docs.sparkSession.sparkContext
    counts = written(count_words(docs, parts, held), "counts")
    ends = docs.filter(~held_out(parts, held)).count()
    r = counts.filter("c > 0").agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = (r["n"] or 0) + ends, r["v"] + (ends > 0)
    denominator = math.log10(n + v + 1)
    logp = piece_scores(counts, model, ends)
    words = written(word_scores(counts, logp), "words")
    is_hot = (F.col("c") > 0) & (F.col("c") * hot >= n) & (F.octet_length("word") <= short)
    frequent = {bytes(x["word"]): (x["c"], math.log10(x["c"] + 1) - denominator, x["lp"]) for x in words.filter(is_hot).toLocalIterator()}  # at most `hot` rows
    shared, end = sc.broadcast(frequent), logp[""]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequent, row = shared.value, TaskContext.get().partitionId() << 40
        for pdf in batches:
            out = []
            for doc_id, held_, text in zip(pdf["doc_id"].astype("Int64"), pdf["held_out"], pdf["text"]):
                tf = Counter(words_of(text))
                known, base, full, rest, times = int(ends > 0), math.log10(ends + 1) - denominator, end, [], []
                for w, k in tf.items():
                    if (x := frequent.get(w)) is None:
                        rest.append(w)
                        times.append(k)
                    else:
                        known += k
                        base += k * x[1]
                        full += k * x[2]
                out.append((row, doc_id, held_, sum(tf.values()) + 1, known, base, full, rest, times))
                row += 1
            yield pd.DataFrame(out, columns=["row", "doc_id", "held_out", "n_tokens", "known", "base", "full", "rest", "times"]).astype({"doc_id": "Int64"})

    schema = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, full double, rest array<binary>, times array<long>"
    scored = written(docs.select("doc_id", held_out(parts, held).alias("held_out"), "text").mapInPandas(run, schema), "scored")
    seen = scored.select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("word"), F.col("x.times").alias("k"))
    rare = (
        seen.join(words.filter(~is_hot), "word")
        .groupBy("row")
        .agg(F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("more"), F.sum(F.col("k") * (F.log10(F.col("c") + 1) - denominator)).alias("rest_score"), F.sum(F.col("k") * F.col("lp")).alias("rest_full"))
    )
    return scored.drop("rest", "times").join(rare, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest_score", F.lit(0.0))).alias("base_score"),
        ((F.col("full") + F.coalesce("rest_full", F.lit(0.0))) / LN10).alias("score"),
    )
