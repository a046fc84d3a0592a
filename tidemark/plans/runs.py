"""Registered queries about fitted gates, chunked runs and promoted batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import lexicon as X
from tidemark.operators import gate, ingest, promotion
from tidemark.operators.records import split_name
from tidemark.sources import ledger, store
from tidemark.sources.scratch import fresh

from .corpus import OWN
from .events import SCORED_SQL, scored
from .registry import query
from .tables import table

#: The thresholds that the sweep looks at.
CUTS = [k / 100 for k in range(10, 95, 5)]


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return e.join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id").withColumn("split", split_name(F.col("doc_id")))


def _gate(spark: SparkSession, sf_dir: str) -> gate.Gate:
    """Fitted on the training part of the labelled vectors."""
    return gate.fit(_labelled(spark, sf_dir).filter("split = 'train'"), "embedding", "toxic")


def _swept(spark: SparkSession, sf_dir: str, fitted: gate.Gate) -> DataFrame:
    scored = _labelled(spark, sf_dir).filter("split = 'val'").withColumn("p", fitted.probability(F.col("embedding")))
    return gate.sweep(scored, "p", "toxic", CUTS)


@query()
def semantic_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's probability and whether it passes the threshold that the sweep chose."""
    fitted = _gate(spark, sf_dir)
    at = gate.best_threshold(_swept(spark, sf_dir, fitted), 0.5)
    p = fitted.probability(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(p, 6).alias("probability"), (p >= at).alias("passed"))


@query()
def gate_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and rates of the gate on the validation part, a row a threshold."""
    return _swept(spark, sf_dir, _gate(spark, sf_dir))


@query()
def gated_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate funnel over all documents; rows without a reason are kept as SEMANTIC where the gate on their vector says so."""
    fitted = _gate(spark, sf_dir)
    at = gate.best_threshold(_swept(spark, sf_dir, fitted), 0.5)
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows = d.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    text = F.lower(F.coalesce(F.col("text"), F.lit("")))
    signals = {"DOMAIN": F.col("source").isin("src0", "src1"), "KEYWORD": ingest.any_substring(text, [*X.KEYWORDS, *OWN])}
    kept = ingest.candidate_filter(rows, signals, fitted.probability(F.col("embedding")), at)
    return kept.select("doc_id", F.array_join("reasons", " + ").alias("reasons"), "kept")


#: Chunks of a run.
CHUNKS = 8
_N = f"greatest(1, ceil(n / ceil(n / {CHUNKS}.0)))"


def _scores(spark: SparkSession, sf_dir: str) -> ledger.Ledger:
    """All events scored in chunks of their ids."""
    run = ledger.Ledger(spark, fresh(spark, "chunks"), {"step": "score", "version": "1"})
    all_scores = scored(spark, sf_dir).select("event_id", "kind", F.round("impact", 9).alias("impact"), "tier")
    events = table(spark, sf_dir, "events")
    run.run(all_scores, "event_id", ledger.ranges(events, "event_id", max(1, -(-events.count() // CHUNKS))), lambda rows: rows.filter("impact > 1"))
    return run


@query(f"with {SCORED_SQL} select event_id, kind, round(impact, 9) as impact, tier from tiered where round(impact, 9) > 1")
def chunked_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a chunked run leaves: the same rows as one pass."""
    return _scores(spark, sf_dir).read("event_id long, kind string, impact double, tier string")


@query(f"""with {SCORED_SQL}, b as (select min(event_id) lo, max(event_id) hi, count(*) n from tiered), w as (select lo, hi, ceil((hi - lo + 1) / {_N})::bigint w from b)
select lo + (event_id - lo) // w * w input_start, lo + (event_id - lo) // w * w + w input_end, 'COMPLETE' status, count(*) input_rows, count(*) filter (round(impact, 9) > 1) output_rows from tiered, w group by 1, 2""")
def chunk_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of the run: ranges, states and rows, as the jobs that wrote the chunks counted them."""
    return _scores(spark, sf_dir).table().select("input_start", "input_end", "status", "input_rows", "output_rows")


@query(f"with {SCORED_SQL}, t as (select count(*) n, count(*) filter (round(impact, 9) > 1) kept from tiered) select {_N}::bigint chunks, n input_rows, kept output_rows, true as timed from t")
def chunk_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ledger.throughput(_scores(spark, sf_dir).table())
    return t.select("chunks", "input_rows", "output_rows", (F.col("rows_per_s") > 0).alias("timed"))


@query("""with c as (select event_id seq, 'S' || user_id || ':' || event_type signal, case when event_id % 7 = 0 then 'RUNNING' else 'COMPLETED' end status, case when value >= 50 then 'live' else 'replay' end as mode from events),
a as (select *, row_number() over (partition by signal order by seq) k from c where status = 'COMPLETED' and not starts_with(signal, 'S1:'))
select c.seq as run, case when c.status <> 'COMPLETED' then 'rejected: status' when k = 1 then 'promoted' else 'rejected: collision' end outcome from c left join a using (seq)""")
def promotion_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events put up for promotion as one batch: the first complete run of a signal takes it, those of the fixtures stay."""
    e = table(spark, sf_dir, "events")
    signal = F.concat(F.lit("S"), F.col("user_id").cast("string"), F.lit(":"), "event_type")
    c = e.select(F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("run_id"), F.when(F.col("value") >= 50, "live").otherwise("replay").alias("mode"), F.when(F.col("event_id") % 7 == 0, "RUNNING").otherwise("COMPLETED").alias("status"), F.array(signal).alias("signals"), F.array(signal).alias("results"))
    fixtures = e.filter("user_id = 1").select(signal.alias("event_id"))
    done = promotion.promote(store.Store(spark, fresh(spark, "promoted")), c, fixtures)
    return done.select(F.col("seq").alias("run"), "outcome")


@query(f"with {SCORED_SQL} select count(*) n, count(*) filter (impact is null) n_null, count(*) filter (impact < 1 or impact > 10) n_out_of_range, count(*) filter (tier not in ('Critical', 'High', 'Moderate', 'Low', 'Minimal')) n_bad_tier, count(*) n_current from tiered")
def checked_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores committed with their checks: one job writes and counts them, and the commit stands only if nothing is wrong."""
    s = scored(spark, sf_dir).select("event_id", "impact", "tier")
    checks = {"n_null": F.col("impact").isNull(), "n_out_of_range": (F.col("impact") < 1) | (F.col("impact") > 10), "n_bad_tier": ~F.col("tier").isin("Critical", "High", "Moderate", "Low", "Minimal")}
    kept = store.Store(spark, fresh(spark, "scores"))
    try:
        n, found = kept.commit({"scores": s}, {"scores": checks})["tables"]["scores"]["rows"], {}
    except store.Rejected as error:
        n, found = 0, error.found
    now = kept.read("scores", "event_id long, impact double, tier string").agg(F.count("*").alias("n_current"))
    return now.select(F.lit(n).cast("bigint").alias("n"), *[F.lit(found.get(c, 0)).cast("bigint").alias(c) for c in checks], "n_current")
