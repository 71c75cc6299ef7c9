"""The corpus pipeline: each stage takes all that the one before kept, and its decisions take effect.

quality   documents that the quality rules reject go
near      of each group of near copies one document stays
secrets   spans that hold secrets are masked in the text
mixing    documents are dropped or repeated so that the sources meet their target weights
packing   what is left is packed into sequences of tokens (the rows of run())
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabwork.llm import mixing, packing, parity_join, quality_rules, secret_scan
from tabwork.llm.common import saved


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.quality_filter(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return parity_join.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [("quality", quality), ("near", near_copies), ("secrets", secrets), ("mixing", mix), ("packing", pack)]

#: Packing and tokens are beyond SQL; tests/llm/test_pipeline.py holds every stage against SQL or plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
