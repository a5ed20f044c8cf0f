"""A training corpus from ``documents``: quality, near-duplicates, leaks, mixture, shards.

Each stage takes ``(spark, docs, sf_dir)`` and returns a frame that is written
as Parquet and read again as the next stage's ``docs``. All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from featurespark.llm import decontaminate, mixing, quality_crf, sharding, simhash_dedup
from featurespark.llm.shared import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least one half."""
    model = quality_crf.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_crf.score_quality(docs, model, score_col="_quality", keep_from=0.5).drop("_quality")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates."""
    return simhash_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark passage is found."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each copy of a document that it takes."""
    return mixing.mix(docs)[1]


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix with shard and slot."""
    return sharding.shard_documents(docs)


STAGES = [("quality classifier", quality), ("SimHash near-dedup", near_duplicates),
          ("benchmark decontamination", decontamination), ("mixing sources to target weights", mixture),
          ("sharding", shards)]

ORACLE_SQL = None      # a trained model, fingerprints and alignments: tested against brute force instead


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
