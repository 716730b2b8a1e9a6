"""The corpus pipeline: toxicity, near-duplicates, decontamination, mixing, sharding.

Each stage takes what the one before kept. The first three keep or drop whole documents, mixing repeats or leaves out documents, and sharding adds
shard and slot. Null, empty and repeated rows have the results that each operator's module states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weblode.llm import decontaminate, mixing, sharding, simhash, toxicity
from weblode.llm.common import Scratch, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.civil(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.distinct_documents(spark, docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(spark, docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(spark, docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash", drop_near_duplicates),
    ("decontaminate", drop_benchmark_leaks),
    ("mix", mix_sources),
    ("shard", shard),
]

#: String kernels, XXH64 fingerprints and latent search have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is stored in the shared folder, so that it runs once and survives lost executors."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        with Scratch.released():
            docs = scratch.store(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
