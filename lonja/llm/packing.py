"""Best-fit-decreasing packing of token sequences.

Texts are encoded where they are read; only (doc_id, piece, length, checksum) rows are shuffled, into
shards of about `pieces_per_shard` pieces by hash. Each shard is packed by best fit decreasing: the open
bins are kept by remaining capacity under a segment tree over capacities, which gives the tightest bin
that still fits in logarithmic time. A shard leaves at most one badly filled bin, one in thousands.

Defined results: null or empty text is the end id alone; rows that repeat are separate documents and are
spread over the shards by the place they were read at; a text longer than a sequence is cut into pieces,
the first of which holds the remainder. A very long text is encoded whole, in the task that reads it. The
strings of special tokens in a text become those tokens' ids, as the tokenizer file says. Further columns
are ignored. No rows give no rows.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonja.llm.common import written

LENGTH, END, RUN = 2048, 0, 2000
_LONG = re.compile(rf"\s{{{RUN}}}|\S{{{RUN}}}")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Texts to little-endian unsigned 32-bit ids of a byte-level vocabulary.

    The vocabulary comes twice: as ranks, which encode ordinary texts fast, and as a tokenizer file. Both
    give the same ids; the second takes texts that hold a special token's string, and texts with runs so
    long that the first's pattern could overflow.
    """

    def __init__(self, path: str, ranks: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks, "rb") as f:
            own = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=own, special_tokens={})
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def __call__(self, text: str) -> bytes:
        if (len(text) > RUN and _LONG.search(text)) or any(s in text for s in self.special):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


def pieces_of(ids: bytes, length: int = LENGTH) -> list[tuple[int, int, bytes]]:
    """(start, length, ids) of each piece; the first takes the remainder."""
    n = len(ids) // 4
    first = n % length or min(n, length)
    cuts = [0, *range(first, n + 1, length)]
    return [(a, b - a, ids[4 * a : 4 * b]) for a, b in zip(cuts, cuts[1:])]


def encoded(docs: DataFrame, tokenizer: tuple[str, str, str], length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """A row per piece; with_ids adds the token ids themselves. tokenizer: tokenizer file, ranks file, pattern."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = Encoder(*tokenizer), np.asarray([END], dtype="<u4").tobytes()
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"].astype(object).where(pdf["doc_id"].notna(), None), pdf["text"]):
                for k, (start, n, ids) in enumerate(pieces_of(encode(text or "") + end, length)):
                    out.append((doc_id, k, start, n, zlib.crc32(ids), *([np.frombuffer(ids, "<u4").astype("i8").tolist()] if with_ids else [])))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(run, PIECES + ", ids array<int>" * with_ids)


class OpenBins:
    """Bins by remaining capacity under a segment tree; tightest(n) is the least capacity of n or more that has a bin."""

    def __init__(self, length: int):
        self.top = 1 << length.bit_length()
        self.count = [0] * (2 * self.top)
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]

    def _add(self, capacity: int, d: int) -> None:
        i = capacity + self.top
        while i:
            self.count[i] += d
            i >>= 1

    def put(self, capacity: int, bin_: int) -> None:
        self.bins[capacity].append(bin_)
        self._add(capacity, 1)

    def take(self, capacity: int) -> int:
        self._add(capacity, -1)
        return self.bins[capacity].pop()

    def tightest(self, n: int) -> int | None:
        i, count = n + self.top, self.count
        if not count[i]:
            while i > 1 and not (i % 2 == 0 and count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.top:
                i = 2 * i if count[2 * i] else 2 * i + 1
        return i - self.top


def best_fit_decreasing(lengths, capacity: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length."""
    lengths = np.asarray(lengths, dtype=np.int64)
    bin_, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_, opened = OpenBins(capacity), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        c = open_.tightest(n)
        if c is None:
            c, b, opened = capacity, opened, opened + 1
        else:
            b = open_.take(c)
        bin_[i], offset[i] = b, capacity - c
        if c - n:
            open_.put(c - n, b)
    return bin_, offset


def pack(pieces: DataFrame, length: int = LENGTH, pieces_per_shard: int = 8192) -> DataFrame:
    """pieces with sequence_id and offset."""
    schema = ", ".join(f"{c} {t}" for c, t in pieces.dtypes)
    pieces = written(pieces.withColumn("place", F.monotonically_increasing_id()), "pieces")  # the table fixes the places
    shards = max(1, -(-pieces.count() // pieces_per_shard))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:  # about pieces_per_shard rows
        pdf = pdf.sort_values("place", kind="stable")
        b, o = best_fit_decreasing(pdf["length"], length)
        return pdf.drop(columns=["shard", "place"]).assign(sequence_id=pdf["shard"].iloc[0] * (1 << 32) + b, offset=o)

    return pieces.withColumn("shard", F.pmod(F.xxhash64("place", "ids_crc32"), F.lit(shards))).groupBy("shard").applyInPandas(run, f"{schema}, sequence_id long, offset long")
