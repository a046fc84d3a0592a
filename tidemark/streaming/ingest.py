"""Structured Streaming versions of the ingest steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import timestamp


RAW = "url string, title string, domain string, seendate string, language string"


def normalised(raw: DataFrame) -> DataFrame:
    """Raw articles with title, time and id; rows without url or date are dropped."""
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("Untitled"))
    rows = raw.withColumn("title", title).withColumn("published_at", timestamp(F.col("seendate"))).filter("url is not null and published_at is not null")
    return rows.withColumn("document_id", F.sha2(F.concat("url", "title").cast("binary"), 256))


def articles(spark: SparkSession, path: str) -> DataFrame:
    """A replay source: JSON lines of raw articles, one file at a time."""
    return normalised(spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).json(path))


def dumps(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A replay source: saved dumps, each a list of articles or an object that holds one as ``articles``; what is neither
    has none.  An article's raw record stays beside it, as JSON in ``metadata``.

    The file source keeps in the checkpoint which dumps are done, so a restart repeats and loses none.  A dump is one row
    until it is taken apart, so it must fit a task."""
    text = spark.readStream.option("maxFilesPerTrigger", files).text(path, wholetext=True).select(F.trim("value").alias("value"))
    whole, inside = F.from_json("value", "array<string>"), F.from_json("value", "articles array<string>")["articles"]
    each = text.select(F.explode(F.when(F.col("value").startswith("["), whole).otherwise(inside)).alias("metadata"))
    raw = each.select(F.from_json("metadata", RAW).alias("a"), "metadata").select("a.*", "metadata")
    raw = raw.withColumn("url", F.nullif(F.col("url"), F.lit(""))).withColumn("language", F.coalesce("language", F.lit("English")))
    return normalised(raw)


def first_seen(stream: DataFrame, late: str = "72 hours") -> DataFrame:
    """Each document once; the state of an id is kept for the watermark's span."""
    return stream.withWatermark("published_at", late).dropDuplicatesWithinWatermark(["document_id"])


def session_counts(stream: DataFrame, key: str, gap: str = "72 hours") -> DataFrame:
    """Sessions of a key: rows no further apart than the gap."""
    g = stream.withWatermark("published_at", gap).groupBy(F.session_window("published_at", gap).alias("w"), key)
    return g.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
