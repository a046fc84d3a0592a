"""Registered queries: canonical records in full, credit contexts, selections, observations, audits, buckets, catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import lexicon as X
from tidemark.functions import scoring
from tidemark.operators import clustering, evaluate, portfolio, promotion, rules
from tidemark.operators import records as R
from tidemark.sources import store
from tidemark.sources.scratch import fresh

from . import portfolio as book
from .checks import _hit
from .events import SCORED_SQL, scored
from .registry import query
from .tables import table


@query(f"""with {SCORED_SQL}, g as (select *, case when lag(ts) over w is null or epoch_us(ts) - epoch_us(lag(ts) over w) > 72::bigint * 3600000000 then 1 else 0 end new from events window w as (partition by user_id order by ts, event_id)),
c as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as cluster from g),
s as (select c.*, 1.0::double / row_number() over (partition by user_id, cluster order by ts, event_id) nov from c), j as (select s.event_id, user_id, cluster, ts, nov, event_type source, props, t.kind, t.impact, t.tier, t.sentiment, t.confidence from s join tiered t using (event_id)),
r as (select *, row_number() over (partition by user_id, cluster order by impact desc, event_id) k from j),
a as (select user_id, cluster, count(*) n, max(impact) mi, round(avg(sentiment), 6) ms, max(confidence) mc, string_agg(distinct source, ',' order by source) src, string_agg(event_id::varchar, ',' order by event_id) ids, md5(string_agg(md5(props), ',' order by event_id)) hs from j group by all)
select a.user_id, a.cluster::bigint as cluster, n observation_count, mi impact_score, ms sentiment_score, mc event_confidence, src source_types, kind event_type, tier impact_tier, nov novelty, ts as "timestamp", event_id representative_id, props representative_text, case when kind = 'Credit Event' then 'guard ' || source end credit_guard_reason, ids source_row_ids, hs source_hashes from a join r using (user_id, cluster) where k = 1""")
def canonical_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of an entity's events within 72 hours, each as one full record."""
    e = clustering.sessions(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", hours=72)
    s = scored(spark, sf_dir).select("event_id", "kind", "impact", "tier", "sentiment", "confidence")
    rows = e.join(s, "event_id").withColumn("guard", F.concat(F.lit("guard "), "event_type"))
    names = {"impact": "impact", "sentiment": "sentiment", "confidence": "confidence", "source": "event_type", "text": "props", "event_type": "kind", "tier": "tier", "novelty": "novelty", "ts": "ts", "guard": "guard"}
    c = clustering.canonical_records(rows, ["user_id", "cluster"], "event_id", names)
    text = lambda name: F.array_join(F.transform(name, lambda x: x.cast("string")), ",")
    return c.withColumn("cluster", F.col("cluster").cast("long")).withColumn("sentiment_score", F.round("sentiment_score", 6)).withColumn("source_types", text("source_types")).withColumn("source_row_ids", text("source_row_ids")).withColumn("source_hashes", F.md5(text("source_hashes")))


_CAT = " union all ".join(f"select id, '{k}' as category from c where {_hit('t', ps)}" for k, ps in X.CREDIT_AUDIT.items())


@query(f"""with r as (select doc_id id, coalesce(text, '') || case doc_id % 4 when 0 then ' The bank missed payments on its bond' when 1 then ' change the default browser' when 2 then ' it defaulted' else ' insolvent' end x from documents), c as (select id, trim(regexp_replace(x, '\\s+', ' ', 'g')) t from r), h as ({_CAT}),
s as (select id, case when {_hit('t', X.CREDIT_ANCHORS)} and not {_hit('t', X.WEAK_CREDIT)} then 'STRONG' else 'WEAK' end strength from c) select category, strength, count(*) n from h join s using (id) group by all""")
def credit_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of credit texts by whether a company anchors them and nothing weak spoils them."""
    k = F.col("doc_id") % 4
    tail = F.when(k == 0, " The bank missed payments on its bond").when(k == 1, " change the default browser").when(k == 2, " it defaulted").otherwise(" insolvent")
    d = table(spark, sf_dir, "documents").select(F.concat(F.coalesce("text", F.lit("")), tail).alias("t"))
    hits = d.select(F.explode(rules.credit_categories(F.col("t"))).alias("category"), rules.credit_context(F.col("t")).alias("strength"))
    return hits.groupBy("category", "strength").agg(F.count("*").alias("n"))


_SCOPED = ["Credit Event", "Merger & Acquisition", "Corporate / Earnings"]


@query(f"""with {SCORED_SQL} select event_id, 'U' || user_id as entity, impact impact_score, kind event_type, ts as "timestamp" from tiered join events using (event_id) where user_id % 3 <> 0 and materiality = 'MATERIAL_EVENT' and impact >= 1 and kind in ({", ".join(repr(t) for t in _SCOPED)}) and user_id between 1 and 40 order by impact desc, ts, event_id limit 1""")
def real_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest valid, material event about an entity of the book."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").alias("timestamp"))
    status = F.when(F.col("user_id") % 3 == 0, "unresolved_entity").otherwise("valid")
    rows = scored(spark, sf_dir).join(e, "event_id").select("event_id", F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("entity"), status.alias("entity_status"), "materiality", F.col("impact").alias("impact_score"), F.col("kind").alias("event_type"), "timestamp")
    return R.strongest(rows, _SCOPED, [f"U{k}" for k in range(1, 41)]).select("event_id", "entity", "impact_score", "event_type", "timestamp")


@query("""with r as (select conv_id, turn, nullif(trim(role), '') h, nullif(trim(text), '') b, case when conv_id % 2 = 0 then 'Acme' end company, case when turn > 0 then role end zone from conversations)
select conv_id, turn, md5(concat_ws(' ', h, b)) text_md5, coalesce(company, 'conv' || conv_id) entity, concat_ws(';', case when company is not null then 'company_name=Acme' end, 'role=' || h, case when zone is not null then 'timezone=' || zone end) metadata, case when h is null and b is null then 'no text' end reject_reason from r""")
def simulated_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as simulation requests with request-wide metadata and company."""
    c = table(spark, sf_dir, "conversations")
    company = F.when(F.col("conv_id") % 2 == 0, "Acme")
    rows = c.select("conv_id", "turn", F.col("role").alias("headline"), F.col("text").alias("body"), F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("entity"), F.create_map(F.lit("role"), F.trim("role"), F.lit("timezone"), F.lit(None).cast("string")).alias("metadata"), company.alias("company"), F.when(F.col("turn") > 0, F.col("role")).alias("zone"))
    o = R.observations(rows, {"company_name": F.col("company"), "timezone": F.col("zone")}, F.col("company"))
    shown = F.array_join(F.array_sort(F.transform(F.filter(F.map_entries("metadata"), lambda e: e["value"].isNotNull()), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return o.select("conv_id", "turn", F.md5("text").alias("text_md5"), "entity", shown.alias("metadata"), "reject_reason")


@query("select doc_id, case when l.doc_id is null then 'n' || d.doc_id else d.doc_id::varchar end row_id, md5(coalesce(text, '')) text_hash, case when toxic is null then 'NON_MATERIAL' when toxic = 1 then 'MATERIAL' else 'CLEAN' end materiality from documents d left join labels l using (doc_id)".replace("select doc_id,", "select d.doc_id,"))
def audit_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an audit shows of each document; missing ids and labels have defaults."""
    l = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "MATERIAL").otherwise("CLEAN").alias("materiality"), F.col("doc_id").cast("string").alias("row_id"))  # noqa: E741
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("number")).join(l, "doc_id", "left")
    return R.audit_rows(rows, "text", "row_id", "number", "materiality").select("doc_id", "row_id", "text_hash", "materiality")


@query("""with e as (select list_sort(list_distinct(quantile_cont(o_totalprice, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) q from orders where o_custkey % 7 <> 0), b as (select (o_custkey % 1000) / 100.0::double - 5 x, len(list_filter(q[2:-2], lambda v: v < o_totalprice))::bigint as bucket from orders, e where o_custkey % 7 <> 0)
select bucket, count(*) n, round(avg(x), 6) mean, round(median(x), 6) median, round(stddev_samp(x), 6) std from b group by 1""")
def bucketed_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, mean, median and spread of a target over the quantile buckets of a score; rows without a target don't count."""
    x = F.when(F.col("o_custkey") % 7 != 0, (F.col("o_custkey") % 1000) / 100.0 - 5)
    b = evaluate.bucket_stats(table(spark, sf_dir, "orders").select("o_totalprice", x.alias("x")), "o_totalprice", "x", 5)
    return b.select(F.col("bucket").cast("long").alias("bucket"), F.col("count").alias("n"), *[F.round(c, 6).alias(c) for c in ("mean", "median", "std")])


@query(book.STRESS_SQL + """ select t.event_id, case when t.event_id in ('E1', 'E2', 'E3') then 'FIXTURE' else 'PROMOTED' end listed_as, case when t.event_id in ('E1', 'E2', 'E3') then null else 'replay' end provenance, n_affected from totals t where t.event_id in ('E1', 'E2', 'E3', 'E4', 'E7')""")
def event_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixtures and what was promoted beside them, with their results; one that has no result isn't listed."""
    fixtures = spark.createDataFrame([("E1",), ("E2",), ("E3",)], "event_id string")
    kept = store.Store(spark, fresh(spark, "catalog"))
    batch = [(1, "r1", "replay", "COMPLETED", ["E4", "E9"], ["E4", "E9"]), (2, "r2", "replay", "COMPLETED", ["E1"], ["E1"]), (3, "r3", "replay", "COMPLETED", ["E7"], ["E7"])]
    promotion.promote(kept, spark.createDataFrame(batch, "seq long, run_id string, mode string, status string, signals array<string>, results array<string>"), fixtures)
    results = portfolio.totals(book.shocks(spark), book.stressed(spark, sf_dir)).select("event_id", "n_affected")
    return promotion.catalog(fixtures, kept.read("promoted_events"), results)


@query("with t as (select case when grouping(o_orderstatus) = 1 then 'all' else o_orderstatus end status, count(*) n from orders group by rollup (o_orderstatus)), w as (select n as whole from t where status = 'all') select status, n, printf('%.1f%%', n::double * 100 / whole) share, printf('%.1f%%', 0.0::double) of_nothing from t, w where status <> 'all'")
def share_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    n = o.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    whole = o.agg(F.count("*").alias("whole"))
    return n.join(F.broadcast(whole)).select("status", "n", R.percent_text(F.col("n"), F.col("whole")).alias("share"), R.percent_text(F.col("n"), F.lit(0)).alias("of_nothing"))  # one row


_HALF = lambda c, n: f"printf('%.{n}f', round(cast(({c})::varchar as decimal(38,17)), {n})::double)"
_SIGN = "case when sentiment < 0 then '-' else '+' end || " + _HALF("abs(sentiment)", 2)


@query(f"""with {SCORED_SQL} select event_id, case materiality when 'NO_EVENT' then 'Gated: Classified as NO_EVENT. Minimal financial significance (impact: 1.0).'
 when 'NON_MATERIAL_FINANCIAL_CONTENT' then 'Gated: Classified as non-material financial content; score constrained to 1.0–2.0 (impact: ' || {_HALF('impact', 1)} || '). Event category ' || chr(39) || kind || chr(39) || ' (base severity: ' || {_HALF('sev', 2)} || ', confidence: ' || {_HALF('confidence', 2)} || ') does not meet corporate materiality thresholds.'
 else concat_ws(' ', tier || ' Impact (' || {_HALF('impact', 1)} || '/10) because this is a material ' || kind || ' (base severity: ' || {_HALF('sev', 2)} || ') with ' || case when confidence >= 0.85 then 'high' when confidence >= 0.6 then 'moderate' else 'weak' end || ' event confidence (' || {_HALF('confidence', 2)} || ') and ' || case when credibility >= 0.9 then 'strong' when credibility >= 0.6 then 'moderate' else 'unverified' end || ' source credibility (' || {_HALF('credibility', 2)} || ').',
   case when sentiment <= -0.4 then 'Downside risk amplified by negative sentiment (' || {_SIGN} || ').' when sentiment >= 0.4 then 'Positive sentiment (' || {_SIGN} || '); impact driven by structural transaction/event size.' else 'Sentiment is neutral (' || {_SIGN} || '); impact driven primarily by event severity.' end,
   case when novelty < 0.7 then 'Dampened by lower novelty (' || {_HALF('novelty', 2)} || ') due to repeated/clustered coverage.' end,
   case when mm > 1.05 then 'Confirmed by elevated market reaction and volatility (market modifier: ' || {_HALF('mm', 2)} || ').' when mm < 0.95 then 'Dampened by muted price/volume reaction.' end) end explanation from tiered""")
def impact_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each score with its reasons."""
    s, c = scored(spark, sf_dir), F.col
    why = scoring.explanation(c("impact"), c("tier"), c("materiality"), c("kind"), scoring.severity(c("kind")), c("confidence"), c("credibility"), c("novelty"), c("sentiment"), c("market_modifier"))
    return s.select("event_id", why.alias("explanation"))
