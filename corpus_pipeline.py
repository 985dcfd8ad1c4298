"""Training-corpus pipeline: quality, near-duplicates, mixture, tokens.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``, written as parquet and read again as the
next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stepwell.llm import bpe, mixing, quality, simhash
from stepwell.llm.queries import MIX_SIZE, TARGETS
from stepwell.plans.scratch import materialize

#: SQL expresses neither the n-gram model nor the byte-pair merges; tests/llm checks each stage.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    return simhash.deduplicated(docs, words_per_shingle=3, max_bits=3)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow the target shares of source, language and topic."""
    return mixing.mixed(docs, TARGETS, MIX_SIZE)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests that prove the round trip."""
    return bpe.token_digests(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix),
    ("byte-level BPE encoding and decoding", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
