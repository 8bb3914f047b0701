"""A corpus from documents to shards: quality, near copies, benchmark leaks, mixture, shards.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import decontam, frames, mixing, ngram_join, quality, sharding

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Their verdict depends on text and language, so rows that share a doc_id agree only if these do."""
    judged = quality.quality(docs.withColumn("doc_id", F.xxhash64("text", "lang")))
    bad = frames.cut(judged.filter("not kept").select(F.col("doc_id").alias("rejected")).distinct())
    return docs.join(bad, F.xxhash64("text", "lang") == F.col("rejected"), "left_anti").select(*COLUMNS)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group linked by the n-gram join."""
    return ngram_join.one_of_each(docs).select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, in rows of documents."""
    return mixing.mixed_documents(docs).select(*COLUMNS)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of the mix."""
    return sharding.shard(docs)


STAGES = [("quality rules", good_quality), ("n-gram Jaccard join", one_of_near_copies), ("benchmark decontamination", without_benchmark), ("mixing to target weights", mixed), ("sharding", sharded)]

#: SQL can't express the join's tree, fingerprints and seeded draws; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = frames.cut(stage(spark, docs, sf_dir))
    return docs
