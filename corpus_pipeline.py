"""From raw documents to training shards: classify, drop near copies, decontaminate, mix, shard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventrates.llm import decontamination, mixing, near_copies, quality_classifier, sharding
from eventrates.llm.queries import classifier_of
from eventrates.llm.storage import own, packed, stored, unpacked


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    read = docs.select(packed(docs, docs.columns).alias("document"), own("doc_id"), own("text"))
    told = quality_classifier.classify(read, classifier_of(read, labels))
    return told.where(F.col("predicted") == 1).select(*unpacked(docs.columns, "document"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: fingerprints of 3-word shingles within two bits, transitively."""
    return near_copies.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, word for word or paraphrased."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources by weight takes them."""
    return mixing.mixed_rows(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its place in 16 shards."""
    return sharding.shard_rows(docs, "doc_id", shards=16)


STAGES = [
    ("quality classifier", classify),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing to source weights", mix_sources),
    ("sharding", shard),
]

# Classifier, fingerprints, latent space and permutation cannot be put in SQL; tests/llm/test_pipeline.py compares by loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
