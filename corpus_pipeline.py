"""The corpus pipeline: documents in, a deduplicated, decontaminated, mixed and sharded corpus out."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import decontam, langid, mix, neardup, shard
from eventloom.session import checkpoint_dir

WEIGHTS = (1.0, 2.0, 3.0)
SHARDS = 8
#: Least share of the posterior that a document's language must have.
SURE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a recognised language; those without letters, or that no language explains better than half, go."""
    return langid.keep_known(docs, ~langid.held_out(F.col("doc_id")), SURE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: shingles of five words, a similarity of 0.8 or more."""
    return neardup.keep_one(docs, k=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that cover half of a benchmark item."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or thins documents until each source's words come near its target."""
    return mix.mix(docs, WEIGHTS)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ``shard`` and ``slot``: shards of equal bytes."""
    return shard.layout(shard.assign(docs, SHARDS))


STAGES = [("language_id", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mixing), ("shard", sharding)]
#: Language scores and signatures have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each is written as Parquet to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
