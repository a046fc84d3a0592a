"""The stages of the corpus pipeline, each a function of (spark, docs, sf_dir).

toxicity removes the documents that the field scores 0.5 or more; near_dedup keeps one document of each
group of texts whose sets of 5-word shingles are 80 % similar or more; substring_dedup removes the words of
passages of 35 words or more that stand in several places; mixing repeats and leaves out documents by the
sources' targets and puts them in training order; encoding returns the token ids.

Defined cases, for each stage: null and empty texts pass it; of repeated rows (equal id and text) near_dedup
keeps one, a null text being none of the empty ones, and the others keep all; ties are those of the operators;
a very long text is handled whole; an empty table gives an empty one; columns beyond those of documents,
whatever their names, are kept until encoding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, minhash, mixing, substring, toxicity
from .common import text_key, written
from .queries import vocabulary


def _decided(docs: DataFrame, decisions: DataFrame, how: str) -> DataFrame:
    """Documents, each as a struct ``row``, with the columns of the decisions (id, ka, kb, ...) about its id and text."""
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("i"), text_key(F.col("text")).alias("k"), F.col("text").isNull().alias("no_text"))
    on = rows["i"].eqNullSafe(decisions["id"]) & (rows["k.a"] == decisions["ka"]) & (rows["k.b"] == decisions["kb"])
    return rows.join(decisions, on, how)


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(*toxicity.sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity.keep_clean(docs, model, threshold=0.5)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(docs, size=5, least=80)
    # Only rows of one group compete: ids may be null or repeated over different texts.
    kept = found.filter("kept").groupBy("label", "id").agg(F.min(F.struct("ka", "kb")).alias("k")).select("id", F.col("k.ka").alias("ka"), F.col("k.kb").alias("kb"))
    return _decided(docs, kept, "inner").dropDuplicates(["i", "ka", "kb", "no_text"]).select("row.*")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = written(substring.dedup(docs).filter("n_removed > 0").select("id", "ka", "kb", "kept_text"), "cut")
    rows = _decided(docs, cut.dropDuplicates(["id", "ka", "kb"]), "left")
    row, text = F.col("row"), F.col("kept_text")
    new = row.withField("text", text)
    if "n_chars" in docs.columns:
        new = new.withField("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return rows.select(F.when(text.isNotNull(), new).otherwise(row).alias("row")).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = vocabulary()
    out = bpe.encode(docs, path)
    return out.select(F.col("id").alias("doc_id"), (F.octet_length("ids") / bpe.codec(path).dtype.itemsize).cast("long").alias("n_tokens"), "ids")
