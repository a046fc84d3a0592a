"""Tables with a key: merge-like unions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new row of a key replaces the old one."""
    both = old.withColumn("__r", F.lit(0)).unionByName(new.withColumn("__r", F.lit(1)), allowMissingColumns=True)
    k = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__r")))
    return both.withColumn("__k", k).filter("__k = 1").drop("__k", "__r")


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the new table join only where their key is not there yet."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def merge_series(old: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """A cache and what was fetched anew, one row a key, the last of both; and per instrument (the first key) how many rows
    were added.  Inside the new rows the last is the one with the largest ``fetched`` where that column is there.

    An instrument without new rows is up to date: its rows stay as they are."""
    added = new.select(*keys).distinct().join(old.select(*keys), keys, "left_anti").groupBy(keys[0]).agg(F.count("*").alias("n_new"))
    order = [F.col("__r"), F.col("fetched")] if "fetched" in new.columns else [F.col("__r")]
    both = old.withColumn("__r", F.lit(0)).unionByName(new.withColumn("__r", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*keys, "__r")]
    merged = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__v"), F.max_by(F.struct(*rest), F.when(F.col("__r") == 0, F.struct(*order))).alias("__o")).join(added, keys[0], "left")
    kept = F.when(F.col("n_new").isNull() & F.col("__o").isNotNull(), F.col("__o")).otherwise(F.col("__v"))
    return merged.withColumn("__k", kept).select(*keys, "__k.*"), added
