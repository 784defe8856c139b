"""Sharding by fixed virtual slots, with DataFrame functions only.

Records hash into thousands of virtual slots. Bytes and rows are summed per slot; only these sums, one
row a slot, reach the driver. A stored slot-to-shard map says where each slot lives. The map is a table of
versions: version 0 deals all slots out in turn; every later version holds just the slots that a
rebalancing moved, single slots from the fullest shard to the emptiest until no move evens them out. A run
on a stored map starts from its latest version and appends the next one, so records move only with moved
slots. The law that holds is `bytes`: the sizes of shards are near equal (they differ by less than the
smallest slot of the fullest shard).

Groups: equal texts are not kept together. A group of copies may hold a third of all bytes, which no law of
near equal sizes leaves in one shard; the hash takes the doc_id with the text's CRC, so a group spreads
over all slots and shards like any other records.

Positions: a slot's rows follow those of the slots before it in the same shard, so only the rows of one
virtual slot are ever sorted together.

Defined results: a null text has no bytes (size 16, the CRC of nothing); a very long text is one record of
its size, read once; rows that repeat are separate records of one slot, in a row; a null doc_id is hashed
like any value. No rows give no rows. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import heapq
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lonja.llm.common import shared_folder, whole, written

SLOTS, SHARDS = 8192, 40


def first_map(slots: int, shards: int) -> list[int]:
    return [s % shards for s in range(slots)]


def rebalanced(shard_of: list[int], sizes: list[int], shards: int) -> list[int]:
    """The next version of a map: slots are moved from the fullest to the emptiest shard while that evens them out."""
    shard_of = list(shard_of)
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(shard_of):
        if sizes[slot]:
            held[shard].append((sizes[slot], slot))
    total = [sum(b for b, _ in h) for h in held]
    for h in held:
        h.sort()
    full, empty = [(-t, i) for i, t in enumerate(total)], [(t, i) for i, t in enumerate(total)]
    heapq.heapify(full)
    heapq.heapify(empty)
    stuck: set[int] = set()
    while True:
        while full and (-full[0][0] != total[full[0][1]] or full[0][1] in stuck):
            heapq.heappop(full)
        while empty and empty[0][0] != total[empty[0][1]]:
            heapq.heappop(empty)
        if not full or not empty:
            return shard_of
        a, b = full[0][1], empty[0][1]
        gap, h = total[a] - total[b], held[a]
        at = bisect.bisect_right(h, (gap // 2, len(shard_of)))
        near = [i for i in (at - 1, at) if 0 <= i < len(h) and h[i][0] < gap]
        if not near:
            return shard_of
        size, slot = h.pop(min(near, key=lambda i: abs(2 * h[i][0] - gap)))
        bisect.insort(held[b], (size, slot))
        shard_of[slot] = b
        for i, d in ((a, -size), (b, size)):
            total[i] += d
            heapq.heappush(full, (-total[i], i))
            heapq.heappush(empty, (total[i], i))


def _array(values: list[int], kind: str):
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


MAP = "version int, virtual_slot int, shard int"


def _stored(spark: SparkSession, path: str) -> tuple[int, dict[int, int]]:
    """The latest version of the map at path and each slot's shard; (-1, {}) where there is none yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return -1, {}
    latest = spark.read.schema(MAP).parquet(path).groupBy("virtual_slot").agg(F.max_by("shard", "version").alias("shard"), F.max("version").alias("version"))
    rows = latest.collect()  # one row a slot
    return max((r.version for r in rows), default=-1), {r.virtual_slot: r.shard for r in rows}


def _append(spark: SparkSession, path: str, version: int, moved: dict[int, int]) -> None:
    """Adds a version: the moved slots and their new shards."""
    slots = sorted(moved)
    if slots:
        at = (F.col("id") + 1).cast("int")
        rows = spark.range(len(slots)).select(F.lit(version).alias("version"), F.element_at(_array(slots, "int"), at).alias("virtual_slot"), F.element_at(_array([moved[x] for x in slots], "int"), at).alias("shard"))
        rows.write.mode("append").parquet(path)


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Records with their shard and place, and the versions of the map stored at path (a new one in the shared folder, if none is named).

    A stored map keeps the number of slots it was made with, whatever `slots` says; one that lacks slots is an error.
    """
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark).rstrip('/')}/slot-map-{uuid.uuid4().hex}"
    version, held = _stored(spark, path)
    if version >= 0:
        slots = len(held)
        if set(held) != set(range(slots)):
            raise ValueError(f"the slot map at {path} is not whole")
    crc = F.crc32(whole().cast("binary"))
    rows = written(
        docs.select("doc_id", (F.octet_length(whole()).cast("long") + 16).alias("size"), crc.alias("text_crc32")).withColumn(
            "virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int")
        ),
        "records",
    )
    sizes, counts = [0] * slots, [0] * slots
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():  # one row a slot
        sizes[r.virtual_slot], counts[r.virtual_slot] = r.b, r.n
    if version < 0:
        version, held = 0, dict(enumerate(first_map(slots, shards)))
        _append(spark, path, version, held)
    start = [held[s] if held[s] < shards else s % shards for s in range(slots)]  # a shard that is no more gives its slots away in turn
    now = rebalanced(start, sizes, shards)
    _append(spark, path, version + 1, {s: x for s, x in enumerate(now) if x != held[s]})
    before, filled = [], [0] * shards
    for s, n in zip(now, counts):
        before.append(filled[s])
        filled[s] += n
    at = F.col("virtual_slot") + 1
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.element_at(_array(now, "int"), at).alias("shard"),
        (F.element_at(_array(before, "bigint"), at) + place - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    ), spark.read.schema(MAP).parquet(path)
