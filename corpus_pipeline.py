"""A training corpus from ``documents``: good, single, clean, mixed and sharded. Counted with strataq.llm."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.llm import decontaminate, mix, quality, shard, simhash
from strataq.llm.common import checkpoint_dir, read_table


# Nulls in any column, empty and very long texts, repeats, empty tables and further columns of any name: as the operator
# that a stage calls says; rows are kept whole, with all their columns, but for the last stage.


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without what the quality classifier rejects (``quality.keep_good``)."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word Jaccard of 0.8 or more (``simhash.keep_alike``)."""
    return simhash.keep_alike(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold benchmark passages (``decontaminate.drop_contaminated``)."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document taken twice is there twice (``mix.resample``)."""
    return mix.resample(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row (``shard.assign``)."""
    return shard.assign(docs).drop("group").withColumn("law", F.lit("rows"))


STAGES = [("quality", good), ("near_duplicates", single), ("decontaminate", clean), ("mix", mixed), ("shard", sharded)]

#: The classifier learns; SQL can't say what it keeps.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written as Parquet in the shared folder and read again by the next; what a stage
    has read is deleted when its own result is written."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{folder}/{name}"
    return docs
