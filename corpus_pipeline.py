"""The pipeline over documents: each stage takes and returns their columns, the last one adds shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridverify.llm import decontaminate, language, pfair, sharding, simhash
from gridverify.llm.common import free_names, staged, table

SHARDS = 8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the lang column teaches.

    Null texts, texts without letters and texts unlike every language go, by limits
    that depend on a text's length.
    """
    return language.in_a_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id.

    Fingerprints of three-word shingles link at three or fewer differing bits.
    """
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.remove_contamination(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, in the order of the sources' schedule.

    A source's weight is its number of documents to the power pfair.POWER, so that
    a source with a third of all documents gets less than a third of the mix until
    others are exhausted; then those that are left go on.
    """
    return pfair.mixed(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with size, shard and slot: eight shards of nearly equal bytes, each in the order of the mix."""
    found = sharding.sharded(docs, SHARDS, in_order=True)
    size, shard, slot = free_names(docs.columns, ["shard_bytes", "shard", "shard_slot"])
    return found.select("row.*", F.col("size").alias(size), F.col("shard").alias(shard), F.col("slot").alias(slot))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding_stage),
]

#: Neither language prototypes nor SimHash groups can be said in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
