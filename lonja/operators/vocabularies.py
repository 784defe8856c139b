"""Vocabularies and normalisers: fitted by aggregation, kept as tables, applied by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lonja.functions.text import label
from lonja.operators.catalogue import half_up
from lonja.operators.matching import ranked, rows_of
from lonja.sources.tables import table

PADDING, UNKNOWN, START = 0, 1, 2


def fit_vocabulary(words: DataFrame, size: int) -> DataFrame:
    """kind, word, id, n of each kind's `size` commonest words, ids from 2; equal counts by word. words: kind, word."""
    counted = words.filter("word <> ''").groupBy("kind", "word").agg(F.count("*").alias("n"))
    best = ranked(counted, ["kind"], [F.desc("n"), F.col("word")], size, "place")
    return best.select("kind", "word", (F.col("place") + (START - 1)).cast("int").alias("id"), "n")


def encoded(rows: DataFrame, vocabulary: DataFrame, length: int | None = None) -> DataFrame:
    """key, ids: the rows' words as ids, those outside the vocabulary as 1, in their order.

    rows: key, kind, words (array). With a length, shorter rows are filled up with 0 and longer ones cut, as a model with
    inputs of that length has it; without one, whole rows. Rows without words have no ids, or only zeros.
    """
    each = rows.select("key", "kind", F.posexplode("words").alias("at", "word"))
    if length is not None:
        each = each.filter(F.col("at") < length)
    found = each.join(vocabulary.select("kind", "word", "id"), ["kind", "word"], "left")
    ids = found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("id", F.lit(UNKNOWN)).alias("id"))))["id"].alias("ids"))
    out = rows.select("key").join(ids, "key", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<int>")))
    if length is not None:
        zeros = F.array_repeat(F.lit(PADDING), F.greatest(F.lit(length) - F.size("ids"), F.lit(0)))
        out = out.withColumn("ids", F.concat("ids", zeros))
    return out


def fit_normaliser(values: DataFrame) -> DataFrame:
    """name, mean, variance (of the population) of each named number; nulls count as 0. values: name, value."""
    return values.groupBy("name").agg(F.avg(F.coalesce("value", F.lit(0.0))).alias("mean"), F.var_pop(F.coalesce("value", F.lit(0.0))).alias("variance"))


def normalised(value: Column, mean: Column, variance: Column) -> Column:
    return (value - mean) / F.greatest(F.sqrt(variance), F.lit(1e-7))


def _words(text: Column) -> Column:
    return F.filter(F.split(label(text), " "), lambda t: t != "")


def words_of_text(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[ \t\n\r]+"), lambda t: t != "")


def vocabulary_encode(spark: SparkSession, d: str) -> DataFrame:
    """Descriptions of parts as eight ids of a vocabulary of twenty words, and whole documents as ids of one of two thousand."""
    part = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("key"), F.lit("part").alias("kind"), _words(F.concat_ws(" ", "p_name", "p_type", "p_brand")).alias("words"))
    docs = table(spark, d, "documents").filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("key"), F.lit("document").alias("kind"), words_of_text(F.col("text")).alias("words"))
    out = []
    for rows, size, length in ((part, 20, 8), (docs, 2000, None)):
        vocabulary = fit_vocabulary(rows.select("kind", F.explode("words").alias("word")), size)
        kind = "part" if length else "document"
        ids = encoded(rows, vocabulary, length)
        out.append(ids.select(F.lit(kind).alias("of"), F.col("key").alias("id"), F.size("ids").cast("long").alias("n"), F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids")))
    return out[0].unionByName(out[1])


#: The numbers of a pair's sides that a model takes in.
NUMBERS = ("cost_log", "weight", "factor_log", "content_log", "total_log")


def numeric_normaliser(spark: SparkSession, d: str) -> DataFrame:
    """Mean and variance of the sides' numbers, and how far the values lie from the mean at most, over both relations."""
    facts, master = rows_of(spark, d)
    each = lambda df, p: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"{p}_{c}").alias("value")) for c in NUMBERS])).alias("x")).select("x.*")
    values = each(facts, "f").unionByName(each(master, "m"))
    fitted = fit_normaliser(values)
    far = values.join(F.broadcast(fitted), "name").groupBy("name").agg(F.max(F.abs(normalised(F.col("value"), F.col("mean"), F.col("variance")))).alias("far"))  # one row a name
    return fitted.join(far, "name").select("name", half_up(F.col("mean"), 6).alias("mean"), half_up(F.col("variance"), 6).alias("variance"), half_up(F.col("far"), 4).alias("far"))


QUERIES = {f.__name__: f for f in (vocabulary_encode, numeric_normaliser)}
