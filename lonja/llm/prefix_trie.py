"""Trie of conversation prefixes by truncation peeling.

A node is a distinct sequence of turns (role, text) that at least one conversation starts with; its key is a
chained 128-bit digest of the turns, so that equal sequences have equal keys and no text travels.

1. The turns of a conversation are numbered and their digests chained, one conversation after the other.
2. A conversation leaves the others at the deepest node that it shares. What it has below is a chain of
   nodes of its own, of which everything is known at once; the chain counts as one child of that node.
3. Peeling goes from the deepest shared depth up to the root. At each depth the conversations that end (or
   leave) there are merged with the nodes that survive from below; counts, children, leaves and saved
   tokens are summed in the same grouping that finds the nodes. The nodes' last turn is stripped and what
   is left is grouped again one depth higher. There is one job per depth at which turns are shared.

Hot turns: a node that a third of all conversations start with is met through salted keys; sums form before
every shuffle. The ids that end at a node are joined into pieces of bounded size where the sorted ids lie, and
hashed piece by piece, so that no list of ids is held at once.

Defined results: rows without conv_id belong to no conversation. Null turns come first, then turns in order;
rows that repeat a turn all count, by role and then by digest. Null role or text is empty. Turns of any length
are hashed whole. A conversation without turns ends at the root. Further columns are ignored. No rows give no
nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lonja.llm.common import discarded, written

SALTS, PIECE = 64, 50_000
EMPTY = hashlib.sha256(b"").hexdigest()


def _salt():
    return F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int")


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), turn (digest), chars of every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    turns = conversations.filter("conv_id IS NOT NULL").select("conv_id", F.col("turn").alias("at"), role.alias("role"), digest.alias("turn"), F.length(text).cast("long").alias("chars"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("at"), "role", "turn")
    return turns.select("conv_id", F.row_number().over(order).cast("long").alias("place"), "turn", "chars")


def rebuilt(turns: DataFrame, span: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first turns of the first one of their span, as (conv_id, place, turn, chars) and (conv_id, n).

    The number of such turns is a remainder of the id's crc32; a conversation keeps its own turns after as many.
    """
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).alias("h")
    sizes = turns.groupBy("conv_id").agg(F.max("place").alias("own"))
    known = sizes.select("conv_id", "own", h, (F.col("conv_id") - F.col("conv_id") % span).alias("base"))
    first = turns.filter((F.col("conv_id") % span == 0) & (F.col("place") < heads))
    base_sizes = first.groupBy(F.col("conv_id").alias("base")).agg(F.max("place").alias("of_base"))
    known = known.join(base_sizes, "base", "left").withColumn("taken", F.least("h", F.coalesce("of_base", F.lit(0))).cast("long"))
    known = written(known.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")), "known")
    own = turns.join(known.select("conv_id", "h", "taken"), "conv_id").filter("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "turn", "chars")
    shared = first.withColumnRenamed("conv_id", "base").join(known.filter("taken > 0").select("conv_id", "base", "taken"), "base").filter("place <= taken")
    return own.unionByName(shared.select("conv_id", "place", "turn", "chars")), known.select("conv_id", "n")


def _chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come by conversation and place; the key of a turn covers all turns up to it."""
    key, of = b"", None
    for pdf in batches:
        keys = []
        for conv_id, turn in zip(pdf["conv_id"], pdf["turn"]):
            key, of = hashlib.blake2b((key if conv_id == of else b"") + turn, digest_size=16).digest(), conv_id
            keys.append(key)
        yield pd.DataFrame({"conv_id": pdf["conv_id"], "depth": pdf["place"], "key": keys, "chars": pdf["chars"]})


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come by key and id; ids of a key are joined, PIECE at a time."""
    key, ids = None, []

    def piece():
        return pd.DataFrame({"key": [key], "start": [ids[0]], "ids": [",".join(map(str, ids))]})

    for pdf in batches:
        for k, i in zip(pdf["key"], pdf["conv_id"]):
            if ids and (k != key or len(ids) == PIECE):
                yield piece()
                ids = []
            key = k
            ids.append(int(i))
    if ids:
        yield piece()


def _digested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come by key and start; the digest of a key's ids, piece after piece."""
    key, sha = None, None
    for pdf in batches:
        out = []
        for k, ids in zip(pdf["key"], pdf["ids"]):
            if sha is not None and k == key:
                sha.update(b"," + ids.encode())
                continue
            if sha is not None:
                out.append((key, sha.hexdigest()))
            key, sha = k, hashlib.sha256(ids.encode())
        yield pd.DataFrame(out, columns=["key", "ends_sha256"])
    if sha is not None:
        yield pd.DataFrame({"key": [key], "ends_sha256": [sha.hexdigest()]})


def ends(ended: DataFrame) -> DataFrame:
    """key, ends_sha256 from (key, conv_id) rows: the digest of each key's ids in ascending order, joined by commas."""
    parts = int(ended.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = ended.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    pieces = ordered.mapInPandas(_joined, "key binary, start long, ids string")
    return pieces.repartition(parts, "key").sortWithinPartitions("key", "start").mapInPandas(_digested, "key binary, ends_sha256 string")


def shared_paths(chains: DataFrame) -> DataFrame:
    """conv_id, path: the nodes, from the top, that a conversation has in common with another."""
    salted = chains.withColumn("salt", _salt())
    some = salted.groupBy("key", "salt").agg(F.count("*").alias("n"))
    several = some.groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1").select("key")
    held = salted.join(some.join(several, "key", "left_semi").select("key", "salt"), ["key", "salt"], "left_semi")
    return held.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("depth", "key", "chars"))).alias("path"))


def _key(path: str = "path"):
    """The key of a path's last node; the root's is empty."""
    return F.coalesce(F.try_element_at(path, F.lit(-1))["key"], F.lit(b""))


def _peeled(rows: DataFrame, depth: int) -> DataFrame:
    """The nodes of a depth from what ends, leaves or survives there."""
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    nodes = rows.groupBy("key").agg(F.min("conv_id").alias("conv_id"), *sums, F.first("path").alias("path"))
    chars = F.coalesce(F.try_element_at("path", F.lit(-1))["chars"], F.lit(0))
    return nodes.withColumns({
        "depth": F.lit(depth).cast("long"),
        "n_leaves": F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.col("n_leaves")).cast("long"),
        "saved_tokens": (F.col("saved_tokens") + (F.col("n_convs") - 1) * chars).cast("long"),
    })


def _stripped(nodes: DataFrame) -> DataFrame:
    path = F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))
    return nodes.select(path.alias("path"), "conv_id", "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens").withColumn("key", _key())


def trie(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row per node, from (conv_id, place, turn, chars) and (conv_id, n).

    A node's last turn is turn `depth` of conversation `conv_id`; join on both for its text.
    """
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = turns.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "place")
    chains = written(ordered.mapInPandas(_chained, "conv_id long, depth long, key binary, chars long"), "chains")
    starts = sizes.join(shared_paths(chains), "conv_id", "left")
    none = F.array().cast("array<struct<depth:bigint,key:binary,chars:bigint>>")
    starts = starts.withColumn("path", F.coalesce("path", none)).withColumns({"depth": F.size("path").cast("long"), "key": _key()})
    starts = written(starts, "starts")
    discarded(chains)

    leaves = F.count_if(F.col("n") > F.col("depth")).cast("long")
    ready = starts.groupBy("depth", "key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), leaves.alias("n_children"), leaves.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.first("path").alias("path"))
    ready = written(ready, "ready")
    deepest = ready.agg(F.max("depth")).first()[0]
    levels, survivors = [], None
    for depth in range(deepest or 0, -1, -1):
        rows = ready.filter(F.col("depth") == depth).drop("depth")
        levels.append(written(_peeled(rows.unionByName(survivors) if survivors else rows, depth), "level"))
        survivors = _stripped(levels[-1])
    nodes = levels[0]
    for level in levels[1:]:
        nodes = nodes.unionByName(level)

    # Chains of a conversation's own hang below the node where it leaves; both they and nodes look up their parent's id.
    tops = starts.filter("n > depth").select("conv_id", F.col("key").alias("parent"), "n", F.col("depth").alias("above"))
    below = nodes.filter("depth > 0").withColumn("parent", F.coalesce(F.try_element_at("path", F.lit(-2))["key"], F.lit(b"")))
    below = below.select("conv_id", "parent", F.lit(None).cast("long").alias("n"), (F.col("depth") - 1).alias("above"))
    hanging = tops.unionByName(below).withColumn("salt", _salt())
    firsts = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    firsts = hanging.select("parent", "salt").distinct().join(firsts, "parent")
    hung = hanging.join(firsts, ["parent", "salt"])

    depth = F.explode(F.sequence(F.col("above") + 1, F.col("n")))
    own = hung.filter("n IS NOT NULL").select("conv_id", depth.alias("depth"), "n", "above", "parent_conv_id").select(
        "conv_id",
        "depth",
        F.when(F.col("depth") == F.col("above") + 1, F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"),
        (F.col("depth") < F.col("n")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("depth") == F.col("n"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(EMPTY).alias("ends_sha256"),
    )
    parents = hung.filter("n IS NULL").select("conv_id", (F.col("above") + 1).alias("depth"), "parent_conv_id")
    shared = nodes.join(ends(starts.filter("n = depth").select("key", "conv_id")), "key", "left").join(parents, ["conv_id", "depth"], "left")
    shared = shared.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
    return shared.unionByName(own)


#: The same result as DuckDB SQL; the reductions are crc32, bit by bit.
SQL = """
WITH t AS (SELECT conv_id AS c, length(coalesce(text, ''))::BIGINT AS chars, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT c, CAST(c - c % 100 AS BIGINT) AS b, CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
    lambda s, x: list_reduce([xor(s, x), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda y, z: xor(y >> 1, 3988292384::UBIGINT * (y & 1::UBIGINT)))), 4294967295::UBIGINT) % 6 AS BIGINT) AS h
  FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT crc.c, p, k, chars, 0 AS own FROM crc JOIN t ON t.c = crc.b AND p <= h UNION ALL SELECT t.c, p, k, chars, 1 FROM t JOIN crc ON t.c = crc.c WHERE p > h),
n AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, p) AS depth, k, chars FROM r),
l AS (SELECT crc.c, coalesce(max(depth), 0) AS len FROM crc LEFT JOIN n ON n.c = crc.c GROUP BY crc.c),
m AS (SELECT c, depth, string_agg(k, '') OVER (PARTITION BY c ORDER BY depth) AS key, chars FROM n UNION ALL SELECT c, 0, '', 0 FROM l),
nodes AS (SELECT key, depth, min(m.c) AS conv_id, count(*) AS n_convs, max(chars) AS chars, coalesce(string_agg(CASE WHEN len = depth THEN m.c::VARCHAR END, ',' ORDER BY m.c), '') AS ends FROM m JOIN l ON l.c = m.c GROUP BY key, depth),
kids AS (SELECT left(key, -32) AS parent, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.parent = nodes.key AND kids.depth = nodes.depth),
up AS (SELECT m.key, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((f.n_convs - 1) * f.chars) AS saved FROM full_nodes f JOIN m ON m.c = f.conv_id AND m.depth <= f.depth GROUP BY m.key)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, o.conv_id AS parent_conv_id, CAST(f.n_convs AS BIGINT) AS n_convs, CAST(f.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_nodes f JOIN up ON up.key = f.key LEFT JOIN nodes o ON f.depth > 0 AND o.key = left(f.key, -32) AND o.depth = f.depth - 1
"""
