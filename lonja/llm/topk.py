"""Exact top-k search by tiled matrix products.

Vectors are packed into binary blocks where they stand. Candidates' blocks belong to shards, queries'
tiles to query groups; every cell (shard, query group) gets its blocks and tiles by an equi-join on the
cell, so that a task holds a block and a tile at a time, whatever the numbers of vectors and queries. A
tile times a block is one matrix product; the k best of each query in it leave the task. Lists of a query
are then merged in a tree: shard by shard, then 16 shards at a time.

Arithmetic is exact: components are whole numbers; a product runs in float32, float64 or Python integers,
whichever the largest possible score allows.

Defined results: vectors that are null or hold null, NaN or infinite components, and rows without vec_id,
take no part. Every row is a candidate of its own, rows that repeat a vec_id included, and a query row is
only never its own partner; each query row has its own list. A shorter vector is padded with zeros. Ties
go to the smaller vec_id. Scores beyond 64 bits are held at the limits. Further columns are ignored. No
rows or no queries give no rows. (Texts, and so very long ones, do not occur.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lonja.llm.common import written

BLOCK, TILE = 8192, 1024
PACKED = "shard int, grp int, n int, dim int, kind string, ids binary, marks binary, vecs binary"


def _packer(scale: float, rows: int, groups: int, query: bool):
    """Packs partitions of (vec_id, mark, v) into blocks of whole-number vectors, two bytes a component where that holds them."""

    def pack(ids: list, marks: list, vecs: list) -> pd.DataFrame:
        dim = max(map(len, vecs))
        m = np.zeros((len(ids), dim))
        for row, v in zip(m, vecs):
            row[: len(v)] = np.floor(scale * np.asarray(v, dtype=np.float64))
        ids, marks = np.asarray(ids, dtype=np.int64), np.asarray(marks, dtype=np.int64)
        order = np.lexsort((marks, ids))
        at = int(marks[order[0]] * 2654435761 % (1 << 31)) % groups  # a block keeps to one group
        kind = "<i2" if np.abs(m).max(initial=0) < 1 << 15 else "<f8"
        place = (-1, at) if query else (at, -1)
        return pd.DataFrame([(*place, len(ids), dim, kind, ids[order].tobytes(), marks[order].tobytes(), m[order].astype(kind).tobytes())], columns=["shard", "grp", "n", "dim", "kind", "ids", "marks", "vecs"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list = []
        marks: list = []
        vecs: list = []
        for pdf in batches:
            ids += pdf["vec_id"].tolist()
            marks += pdf["mark"].tolist()
            vecs += pdf["v"].tolist()
            while len(ids) >= rows:
                yield pack(ids[:rows], marks[:rows], vecs[:rows])
                ids, marks, vecs = ids[rows:], marks[rows:], vecs[rows:]
        if ids:
            yield pack(ids, marks, vecs)

    return run


def best_of(q: np.ndarray, q_marks: np.ndarray, c: np.ndarray, c_ids: np.ndarray, c_marks: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate, score) of each query's k best among the block, rows and candidates by place; block ids ascend; a row (by mark) is never its own partner."""
    dim = max(q.shape[1], c.shape[1])
    q, c = (np.pad(x, ((0, 0), (0, dim - x.shape[1]))) for x in (q, c))
    bound = float(dim) * (np.abs(q).max(initial=0) * np.abs(c).max(initial=0)) if dim else 0.0
    by_mark = np.argsort(c_marks, kind="stable")
    at = by_mark[np.minimum(np.searchsorted(c_marks[by_mark], q_marks), len(c_marks) - 1)]
    own = c_marks[at] == q_marks
    if bound < 2.0**39:
        kind = np.float32 if bound < 2.0**24 else np.float64
        score = (q.astype(kind) @ c.T.astype(kind)).astype(np.float64)
        key = score * (1 << 14) + (len(c_ids) - 1 - np.arange(len(c_ids)))  # whole numbers below 2**53, none twice
        key[np.flatnonzero(own), at[own]] = -np.inf
        top = np.argpartition(-key, k - 1, axis=1)[:, :k] if len(c_ids) > k else np.tile(np.arange(len(c_ids)), (len(q), 1))
        rows = np.repeat(np.arange(len(q)), top.shape[1])
        cols = top.ravel()
        ok = key[rows, cols] > -np.inf
        rows, cols = rows[ok], cols[ok]
        return rows, cols, score[rows, cols].astype(np.int64)
    whole, out = [[int(x) for x in row] for row in c], []
    for i, row in enumerate(q):
        a = [int(x) for x in row]
        scored = sorted((-sum(x * y for x, y in zip(a, b)), j) for j, b in enumerate(whole) if c_marks[j] != q_marks[i])[:k]
        out += [(i, j, max(-(1 << 63), min((1 << 63) - 1, -s))) for s, j in scored]
    a, b, s = zip(*out) if out else ((), (), ())
    return np.asarray(a, np.int64), np.asarray(b, np.int64), np.asarray(s, np.int64)


def _products(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                q = np.frombuffer(r.q_vecs, r.q_kind).reshape(r.q_n, r.q_dim).astype(np.float64)
                c = np.frombuffer(r.vecs, r.kind).reshape(r.n, r.dim).astype(np.float64)
                q_ids, q_marks, ids, marks = (np.frombuffer(x, np.int64) for x in (r.q_ids, r.q_marks, r.ids, r.marks))
                a, b, s = best_of(q, q_marks, c, ids, marks, k)
                yield pd.DataFrame({"part": np.int32(r.shard), "query_id": q_ids[a], "query_row": q_marks[a], "vec_id": ids[b], "vec_row": marks[b], "score": s})

    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, shard_rows: int = 32768, group_rows: int = 65536) -> DataFrame:
    """query_id, rank, vec_id, score: the k best partners of each row whose vec_id is divisible by `every`."""
    v = F.col("embedding")
    sound = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    rows = written(rows.withColumn("mark", F.monotonically_increasing_id()), "vectors")  # the table fixes each row's mark
    asked = rows.filter(F.col("vec_id") % every == 0)
    shards, groups = max(1, -(-rows.count() // shard_rows)), max(1, -(-asked.count() // group_rows))
    blocks = rows.mapInPandas(_packer(scale, BLOCK, shards, False), PACKED).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    tiles = asked.mapInPandas(_packer(scale, TILE, groups, True), PACKED).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    tiles = tiles.select("shard", "grp", *[F.col(c).alias(f"q_{c}") for c in ("n", "dim", "kind", "ids", "marks", "vecs")])
    lists = blocks.join(tiles, ["shard", "grp"]).mapInPandas(_products(k), "part int, query_id long, query_row long, vec_id long, vec_row long, score long")
    order = [F.col("score").desc(), F.col("vec_id"), F.col("vec_row")]
    while True:
        lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_row", "part").orderBy(*order))).filter(F.col("rank") <= k)
        if shards == 1:
            return lists.select("query_id", "rank", "vec_id", "score")
        lists, shards = lists.withColumn("part", F.floor(F.col("part") / 16).cast("int")), -(-shards // 16)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""
