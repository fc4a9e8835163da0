"""The corpus pipeline: each stage reads what its predecessor wrote.

Defined cases, for all stages: an empty table gives an empty table; other columns, also of names that the operators
use, are carried; repeated rows and null ids are rows like others. A null or empty text fails the quality
rules, so later stages meet none unless they are called alone: near-duplicates then keep one of all such texts,
decontamination keeps them all, mixing gives them the rate of a text without evidence, and sharding a size of one byte.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hookloom.llm import decontaminate, mixing, quality, sharding, simhash
from hookloom.session import stage_table


# Of what the stages before leave, about 3 % of the tokens are toxic and 1 % poor; half of either is wanted.
MIX = {"clean": 0.98, "toxic": 0.015, "poor": 0.005}


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs, shingle=3, max_distance=2)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), MIX)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(docs, shards=8)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

# The stages are iterative or need functions that SQL lacks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
