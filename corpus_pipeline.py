"""The corpus pipeline: five stages, each written as Parquet and read again before the next.

What the stages do, and what they do with nulls, long texts, ties, repeats and clashing names, is said in
``tidemark.llm.stages``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import stages
from tidemark.llm.common import written

STAGES = [("toxicity", stages.remove_toxic), ("near_dedup", stages.near_dedup), ("substring_dedup", stages.substring_dedup), ("mixing", stages.mix_sources), ("encoding", stages.encode)]
#: The trained field and the tokenizer can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
