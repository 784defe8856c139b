"""Connected components of an edge table: contraction inside partitions, then alternating large and small stars.

Before a round shuffles, each task replaces the edges it reads, some at a time, by the stars of their own
components. That keeps all connections, needs no shuffle and shortens chains, so few rounds remain. The
rounds end when the edges are stars: no node has two parents, and none is both a child and a parent.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonja.llm.common import discarded, written

_EDGES = 200_000  # edges that a task contracts at once


def _stars(pdf: pd.DataFrame) -> pd.DataFrame:
    """The edges as (node, smallest node of its component among these edges)."""
    up: dict = {}

    def find(x):
        while (above := up.setdefault(x, x)) != x:
            up[x] = up[above]
            x = up[x]
        return x

    for a, b in zip(pdf["a"], pdf["b"]):
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return pd.DataFrame([(x, r) for x in list(up) if (r := find(x)) != x], columns=["a", "b"])


def _contracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    for pdf in batches:
        held.append(pdf.map(bytes) if len(pdf) and isinstance(pdf["a"].iloc[0], bytearray) else pdf)
        if sum(map(len, held)) >= _EDGES:
            yield _stars(pd.concat(held))
            held = []
    if held:
        yield _stars(pd.concat(held))


def _settled(e: DataFrame) -> bool:
    ends = e.select(F.col("a").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionAll(e.select(F.col("b").alias("node"), F.lit(0), F.lit(1)))
    seen = ends.groupBy("node").agg(F.sum("child").alias("children"), F.max("parent").alias("parent"))
    return seen.agg(F.count(F.when((F.col("children") > 1) | (F.col("children") * F.col("parent") > 0), 1)).alias("n")).first().n == 0


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) of every node with an edge; label is the smallest node reachable. Edges: columns a, b."""
    contracted = lambda df: df.select("a", "b").mapInPandas(_contracted, edges.select("a", "b").schema)
    e = written(contracted(edges.filter("a <> b")).distinct(), "edges")
    for _ in range(rounds):
        if _settled(e):
            break
        was, e = e, contracted(e)
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
        e = written(small.filter("a <> b").distinct(), "edges")
        discarded(was)
    else:
        raise RuntimeError(f"components had not settled after {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
