"""From raw documents to packed training sequences: five stages, each on all that the one before it kept.

Every stage takes rows with null ids or texts, empty and very long texts, repeats, empty tables and columns of any name;
what becomes of them stands in the docstring of its module: toxicity, exact_dedup, minhash, mixing, packing.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from lonja.llm import exact_dedup, minhash, mixing, packing, toxicity
from lonja.llm.common import documents, written
from lonja.llm.queries import byte_bpe


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str, **folds) -> DataFrame:
    """Documents that the classifier rejects go; `folds` are those of `toxicity.learn`."""
    return toxicity.keep_clean(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), **folds))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity of 0.8 or more."""
    return minhash.drop_near_duplicates(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often, and as much of it, as its chosen blocks say."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with the sequence and the place in it that they take."""
    return packing.pack(packing.encoded(docs, byte_bpe()))


#: The pipeline measures no model, so its toxicity stage learns from every document and label.
STAGES = [
    ("toxicity", partial(drop_toxic, held=None)),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: Trained models, tokenizers and signatures have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
