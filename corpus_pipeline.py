"""A corpus from raw documents to token ids, stage by stage.

Each stage gets what its predecessor kept and returns it with the columns of ``documents``; the last one
returns token ids. ``run`` writes every stage as Parquet below the shared folder and reads it back, so a
stage is computed once and lost executors cost no more than the stage at work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import benchmark, bpe, exact, jaccard, language
from tidemark.llm.common import table, written

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: null texts, texts without a letter, texts that fit none."""
    return language.keep_identified(docs, language.train(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, keep the longest."""
    return exact.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group of documents linked by a Jaccard similarity of 0.8, keep the one with the smallest id."""
    return jaccard.keep_one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that have an item of the benchmark."""
    return benchmark.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of the ids and of the text decoded from them."""
    import public_tokenizers

    return bpe.token_digests(docs, public_tokenizers.path(VOCABULARY), with_ids=True)


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("tokens", encode),
]

# no SQL can say what languages, near copies or tokens are here; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
