"""The registered queries of the corpus operators: thin, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, lengths, licenses, media, middle, minhash, mixing, quality, repair, sharding, simhash, substring, toxicity
from .common import documents, written
from .oracle import ORACLES as ORACLES


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store_texts(documents(spark, sf_dir))
    return media.features(stored).withColumnRenamed("id", "doc_id")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.plan(documents(spark, sf_dir))
    rows = rows.select("doc_id", "size", "source_size", "target", "taken", F.size("positions").alias("reads"), F.get("positions", F.lit(0)).alias("position"), F.try_element_at("positions", F.lit(-1)).alias("last_position"))
    return rows.orderBy(F.asc_nulls_last("position"), "doc_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(*toxicity.sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    scored = toxicity.score(docs, model)
    return scored.select(F.col("id").alias("doc_id"), toxicity.is_held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary()
    return bpe.digests(bpe.encode(documents(spark, sf_dir), path), path).withColumnRenamed("id", "doc_id")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.dedup(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), shards=8)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.limits(lengths.histogram(documents(spark, sf_dir), vocabulary()))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.near_duplicates(documents(spark, sf_dir), size=3, least=85)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.apply_policy(quality.ledger(documents(spark, sf_dir)), "full-1")
    failed = F.col("fail_bits").bitwiseAND(F.lit(quality.mask("base-1")).cast("bigint")) != 0
    return rows.select("doc_id", *quality.MEASURES, "fail_bits", failed.alias("base_failed"), "kept")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir)).drop("spans")


def op11_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    back = middle.restored(F.col("output"), F.col("form"))
    return middle.fill_in_middle(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(back).alias("restored_sha256"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = repair.damaged(conversations)
    decided = written(repair.decisions(rows), "decisions")
    hashes = repair.digests(repair.repaired(rows, decided)).withColumnRenamed("conv", "c")
    every = conversations.select("conv_id").distinct()
    found = every.join(decided, F.col("conv_id").eqNullSafe(F.col("conv")), "left").join(hashes, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return found.select("conv_id", zero("gaps"), *[zero(c) for c in repair.RULED], zero("cost"), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_media, op2_mixing, op3_toxicity, op4_bpe, op5_substring_dedup, op6_sharding, op7_token_counts, op8_minhash, op9_quality, op10_licenses, op11_middle, op12_simhash, op13_repair, pipeline)}
