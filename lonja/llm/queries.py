"""The queries of the corpus operators: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lonja.llm import exact_dedup, html_text, lattice_lm, lexical, minhash, mixing, packing, pii, prefix_trie, sharding, suffix_dedup, topk, toxicity
from lonja.llm.common import documents, written


def tokenizer(name: str) -> str:
    """Path of a vocabulary file; the files are public ones, installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_bpe() -> tuple[str, str, str]:
    """Tokenizer file, ranks file and pattern of the byte-level vocabulary."""
    import public_tokenizers

    return tokenizer("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(documents(spark, sf_dir))


def op7_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.encoded(documents(spark, sf_dir), byte_bpe()))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))[0]


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(documents(spark, sf_dir))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = written(prefix_trie.numbered(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "turns")
    return prefix_trie.trie(*prefix_trie.rebuilt(turns))


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_topk, op2_toxicity, op3_minhash, op4_mixing, op5_exact_dedup, op6_pii, op7_lattice_lm, op8_packing, op9_sharding, op10_suffix_dedup, op11_lexical, op12_prefix_trie, op13_html_text)
}
#: The other operators have no SQL form (models, tokenizers, hashes that SQL lacks, or pairs of all texts); tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op1_topk": topk.SQL, "op5_exact_dedup": exact_dedup.SQL, "op11_lexical": lexical.SQL, "op12_prefix_trie": prefix_trie.SQL}
