"""Intermediate tables of iterative operators."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(1)
def _own_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='spark-')}"


def fresh(spark: SparkSession, name: str) -> str:
    """A new path below the folder that all executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{named or _own_dir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the folder that all executors share and read it back: it cuts the lineage and survives lost executors."""
    path = fresh(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
