"""Exact dedup: a tree merge of sorted digest runs, with DataFrame functions only.

Every document becomes a digest row. The rows of one input partition are a run; a run is sorted by digest
and keeps one row for each: the longest original text, then the smallest doc_id, with the number of rows it
stands for. Then runs are exchanged in binomial rounds. Runs are numbered in base `fan_in`; in round k the
`fan_in` runs that differ in digit k only are partners, and each row goes to the partner whose digit k is
its digest's. A run sorts what its partners sent it and merges it in one pass, equal digests being
neighbours, and keeps the verified smallest row of each. After the last round a run holds all that is left
of its digests. No run ever holds more than a share of the digests, and a group of copies of any size meets
as at most `fan_in` rows a digest and round. The winners then go back down to the first runs, so that the
final join has at most one run's share of a group in a key.

Verification: runs merge on SHA-256, a second independent 64-bit hash and the byte length together, so a
digest that two texts share by chance does not merge them.

Defined results: a null text counts as empty, and empty texts are one group. Very long texts are hashed
whole and never leave their task. Rows that repeat (same text and doc_id) are all flagged as kept if theirs
is the row that stays; `drop_duplicates` leaves exactly one row of a group. A null doc_id loses against any
other. Further columns may have any name; `drop_duplicates` carries them along as one struct. No rows give
no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonja.llm.common import SPACES, whole, written

KEY = ["sha", "second", "n_bytes"]


def digests(docs: DataFrame) -> DataFrame:
    """One row per document: key columns, doc_id, n_chars and a hash of the original text."""
    norm = F.translate(F.col("_text"), SPACES, "")
    return (
        docs.select("doc_id", whole().alias("_text"))
        .select("doc_id", F.length("_text").alias("n_chars"), F.xxhash64("_text").alias("mark"), norm.alias("_norm"))
        .select("doc_id", "n_chars", "mark", F.unhex(F.sha2("_norm", 256)).alias("sha"), F.xxhash64("_norm").alias("second"), F.octet_length("_norm").alias("n_bytes"))
    )


def merged_runs(first: DataFrame, fan_in: int, rounds: int) -> DataFrame:
    """KEY, best, n after all rounds of exchange between the runs of `first`."""
    level = first
    for k in range(rounds):
        place = fan_in**k
        digit = F.pmod(F.shiftright("second", 5 * k), F.lit(fan_in))
        own = F.floor(F.col("run") / place) % fan_in
        sent = level.withColumn("run", (F.col("run") + (digit - own) * place).cast("int")).repartitionById(fan_in**rounds, "run")
        level = sent.groupBy("run", *KEY).agg(F.min("best").alias("best"), F.sum("n").alias("n"))  # a sort and a merge inside the partition
    return level.select(*KEY, "best", "n")


def _marked(docs: DataFrame, fan_in: int) -> DataFrame:
    """doc_id, n_chars, mark and sha of every row, with its group's best row and size."""
    width, rounds = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1
    while fan_in**rounds < width:
        rounds += 1
    rows = written(digests(docs).withColumn("run", F.pmod(F.spark_partition_id(), F.lit(fan_in**rounds)).cast("int")), "digests")
    best = F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("mark").alias("mark"))
    first = rows.groupBy("run", *KEY).agg(F.min(best).alias("best"), F.count("*").alias("n"))
    per_run = first.select("run", *KEY).join(merged_runs(first, fan_in, rounds), KEY)
    return rows.join(per_run, ["run", *KEY])


def exact_dedup(docs: DataFrame, fan_in: int = 8) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs."""
    return _marked(docs, fan_in).select(
        "doc_id",
        F.col("best.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("doc_id").eqNullSafe(F.col("best.id")) & (F.col("n_chars") == -F.col("best.less"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, fan_in: int = 8) -> DataFrame:
    """docs without the rows that exact_dedup drops, with the columns of docs; of repeated rows one stays."""
    chosen = F.col("doc_id").eqNullSafe(F.col("best.id")) & (F.col("n_chars") == -F.col("best.less")) & (F.col("mark") == F.col("best.mark"))
    stays = written(_marked(docs, fan_in).filter(chosen).groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).agg(F.count("*").alias("_n")), "stays")
    own = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64(whole()).alias("mark"))
    kept = own.join(stays, (F.col("mark") == F.col("_mark")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    if not stays.filter("_n > 1").isEmpty():
        kept = kept.dropDuplicates(["_id", "_mark"])
    return kept.select("row.*")


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS txt, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), k AS (
  SELECT doc_id, norm,
    first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(txt) DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY norm) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
"""
