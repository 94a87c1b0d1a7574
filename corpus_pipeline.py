"""The training-data pipeline over documents.

Language identification, near-deduplication, decontamination, mixing to source weights, sharding. Each stage reads what
its predecessor kept, as Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tremolo.llm import decontaminate, language, mixing, near, sharding
from tremolo.llm.common import discard, settled, table
from tremolo.llm.queries import SHARD_BYTES


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: a text that is null or has no letter goes."""
    return language.keep_identified(docs)


def near_deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id."""
    return near.keep_one(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts; a document that is mostly benchmark goes."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to three times; light sources lose some of theirs."""
    return mixing.apply_mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard."""
    return sharding.shard_documents(docs, SHARD_BYTES)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", near_deduplicate),
    ("decontamination", decontaminate_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Language identification and the network of near copies are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        docs = settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
