"""Registered quality checks and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import lexicon as X
from tidemark.operators import checks, rules

from . import portfolio as book
from .corpus import GUARDED
from .events import SCORED_SQL, scored
from .registry import query
from .tables import table

#: Columns of the tables that would tell a model what came later.
FORBIDDEN = ["o_totalprice", "l_shipdate", "value", "toxic"]


@query("select t as table_name, column_name from (select 'orders' t, column_name from (describe orders) union all select 'lineitem', column_name from (describe lineitem) union all select 'events', column_name from (describe events) union all select 'labels', column_name from (describe labels)) where column_name in ('o_totalprice', 'l_shipdate', 'value', 'toxic')")
def leakage_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [(t, c) for t in ("orders", "lineitem", "events", "labels") for c in checks.leaking(table(spark, sf_dir, t), FORBIDDEN)]
    return spark.createDataFrame(found, "table_name string, column_name string")


@query("with p as (select case when event_id % 97 = 0 then null else (event_id % 10) / 10.0::double end a, (event_id % 7) / 10.0::double b, 1 - (event_id % 10) / 10.0::double - (event_id % 7) / 10.0::double c, value / 100 - 1 s from events) select count(*) n, count(*) filter (a is null or b is null or c is null) n_null, count(*) filter (a not between 0 and 1 or b not between 0 and 1 or c not between 0 and 1) n_out_of_range, count(*) filter (abs(a + b + c - 1) > 0.01) n_bad_sum, count(*) filter (s not between -1 and 1) n_bad_score from p")
def probability_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    d = lambda c: F.expr(c).cast("double") / 10.0
    p = e.select(F.when(F.col("event_id") % 97 != 0, d("event_id % 10")).alias("a"), d("event_id % 7").alias("b"), (1 - d("event_id % 10") - d("event_id % 7")).alias("c"), (F.col("value") / 100 - 1).alias("s"))
    return checks.probabilities(p, ["a", "b", "c"], "s")


@query("select count(*) n, count(*) filter (event_type is null) n_null, count(*) filter (event_type not in ('click', 'view')) n_bad_label, count(*) filter (value / 200 not between 0 and 1) n_bad_confidence, (select string_agg(t, ',' order by t) from (select distinct event_type t from events where event_type not in ('click', 'view') order by 1 limit 5)) examples from events")
def taxonomy_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", (F.col("value") / 200).alias("confidence"))
    return checks.taxonomy(e, "event_type", ["click", "view"], "confidence")


@query("with s as (select case event_id % 50 when 0 then null when 1 then 'nan'::double when 2 then 'inf'::double when 3 then '-inf'::double else value / 10 end s from events) select count(*) n, count(*) filter (s is null) n_null, count(*) filter (isnan(s)) n_nan, count(*) filter (isinf(s)) n_infinite, count(*) filter (s < 1 or s > 10) n_out_of_range from s")
def score_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 50
    s = F.when(k == 0, None).when(k == 1, float("nan")).when(k == 2, float("inf")).when(k == 3, float("-inf")).otherwise(F.col("value") / 10)
    return checks.scores(table(spark, sf_dir, "events").select(s.alias("s")), "s")


@query(f"{book.STRESS_SQL} select count(*) n, count(*) filter (base_el <> ead * pd * lgd) n_identity, count(*) filter (incremental_el <> ead * stressed_pd * stressed_lgd - base_el) n_difference, count(*) filter (stressed_pd not between 0 and 1 or stressed_lgd not between 0 and 1 or stressed_pd < pd or stressed_lgd < lgd) n_bounds, count(*) filter (asset_type = 'Equity' and (stressed_pd <> pd or stressed_lgd <> lgd)) n_equity_changed, count(*) filter (abs(mtm_impact) > ead) n_market_move from stress")
def portfolio_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.stress_invariants(book.stressed(spark, sf_dir))


@query(f"with {SCORED_SQL} select count(*) n_input, count(*) filter (materiality <> 'NO_EVENT') n_relevant, count(*) filter (materiality = 'MATERIAL_EVENT') n_material, count(*) filter (materiality = 'MATERIAL_EVENT' and not (kind = 'Credit Event' and event_id % 3 <> 0)) n_entering, count(distinct case when materiality = 'MATERIAL_EVENT' and not (kind = 'Credit Event' and event_id % 3 <> 0) then kind end) n_types from tiered")
def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    material = F.col("materiality") == "MATERIAL_EVENT"
    enters = material & ~((F.col("kind") == "Credit Event") & (F.col("event_id") % 3 != 0))
    return s.agg(F.count("*").alias("n_input"), checks.n(F.col("materiality") != "NO_EVENT", "n_relevant"), checks.n(material, "n_material"), checks.n(enters, "n_entering"), F.count_distinct(F.when(enters, F.col("kind"))).alias("n_types"))


@query(f"with {SCORED_SQL} select event_id, kind, impact from tiered where materiality = 'MATERIAL_EVENT' and not (kind = 'Credit Event' and event_id % 3 <> 0)")
def material_and_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Material events without the credit events that the guard (here: two of three) turned away."""
    guard = F.col("event_id") % 3 == 0
    return scored(spark, sf_dir).filter((F.col("materiality") == "MATERIAL_EVENT") & ~((F.col("kind") == "Credit Event") & ~guard)).select("event_id", "kind", "impact")


@query(f"with {SCORED_SQL} select kind, count(*) n_before, count(*) filter (event_id % 3 = 0) n_after, count(*) filter (event_id % 3 <> 0) n_turned_away, count(*) filter (event_id % 3 <> 0 and impact >= 7) n_high_turned_away from tiered where materiality = 'MATERIAL_EVENT' group by kind")
def guard_before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, away = scored(spark, sf_dir).filter("materiality = 'MATERIAL_EVENT'"), F.col("event_id") % 3 != 0
    return m.groupBy("kind").agg(F.count("*").alias("n_before"), checks.n(~away, "n_after"), checks.n(away, "n_turned_away"), checks.n(away & (F.col("impact") >= 7), "n_high_turned_away"))


_q = lambda s: s.replace("'", "''")
_hit = lambda t, ps: f"regexp_matches({t}, '(?i)" + _q("|".join(f"(?:{p})" for p in ps)) + "')"
_lits = ", ".join(f"({-k - 1}, '{_q(t[0])}', '{t[1]}')" for k, t in enumerate(GUARDED))
_words = lambda ws: "(" + " or ".join(f"contains(t, '{_q(w)}')" for w in ws) + ")"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lit = spark.createDataFrame([(-k - 1, t[0], t[1]) for k, t in enumerate(GUARDED)], "id long, text string, entity string")
    return lit.unionByName(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("entity")))


_ROWS = f"r(id, text, entity) as (select * from (values {_lits}) union all select doc_id, text, source from documents), l as (select id, lower(coalesce(text, '')) t, lower(coalesce(entity, '')) e from r)"


@query(f"with {_ROWS} select id, case when {_hit('t', X.WEAK_CONTEXTS)} then 'LEXICAL_COLLISION' " + " ".join(f"when e = '{k}' and {_words(ws)} then 'ENTITY_COLLISION'" for k, ws in X.OFFLINE_WORDS.items()) + f" when {_hit('t', X.STRONG_TERMS)} then 'TRUE_CREDIT_EVENT' else 'AMBIGUOUS' end as class from l")
def offline_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("id", rules.offline_guard(F.col("text"), F.col("entity")).alias("class"))


@query(f"with {_ROWS} select case when e in ({', '.join(repr(x) for x in X.COLLIDING)}) then 'FALSE_POSITIVE_ENTITY_COLLISION' when (contains(t, 'default') and contains(t, 'browser')) or contains(t, 'setting') then 'FALSE_POSITIVE_LEXICAL' when contains(t, 'credit') or contains(t, 'bankruptcy') then 'TRUE_CREDIT_EVENT' else 'AMBIGUOUS' end as class, count(*) n from l group by 1")
def naive_credit_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).groupBy(rules.naive_audit(F.col("text"), F.col("entity")).alias("class")).agg(F.count("*").alias("n"))


_AUDIT = " union all ".join(f"select id, '{k}' as category from c where {_hit('t', ps)}" for k, ps in X.CREDIT_AUDIT.items())


@query(f"with r(id, text, entity) as (select * from (values {_lits}) union all select doc_id, text, source from documents), c as (select id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) t from r), h as ({_AUDIT}), k as (select *, row_number() over (partition by category order by id) k from h) select category, count(*) n, count(*) * 100.0::double / (select count(*) from r) pct, string_agg(case when k <= 3 then id::varchar end, ',' order by id) samples from k group by category")
def credit_lexicon_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of each category, their share of all rows, and the first three rows of each."""
    rows = _texts(spark, sf_dir)
    total = rows.agg(F.count("*").alias("total"))
    hits = rows.select("id", F.explode(rules.credit_categories(F.col("text"))).alias("category"))
    each = hits.groupBy("category").agg(F.count("*").alias("n"))
    top = hits.withColumn("k", F.row_number().over(Window.partitionBy("category").orderBy("id"))).filter("k <= 3").groupBy("category").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("samples"))
    return each.join(top, "category").join(F.broadcast(total)).select("category", "n", (F.col("n") * 100.0 / F.col("total")).alias("pct"), "samples")


@query("with c as (select user_id % 7 chunk, case when user_id % 7 = 6 then 'RUNNING' else 'COMPLETE' end status, count(*) n, sum((value * 100)::bigint) ms from events group by 1, 2) select count(*) chunks, sum(n)::bigint n_rows, sum(ms)::bigint ms, round(sum(n) * 1000.0::double / sum(ms), 6) rows_per_s from c where status = 'COMPLETE'")
def stage_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and time of the chunks that are complete."""
    chunk = F.col("user_id") % 7
    c = table(spark, sf_dir, "events").groupBy(chunk.alias("chunk"), F.when(chunk == 6, "RUNNING").otherwise("COMPLETE").alias("status")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("ms"))
    return c.filter("status = 'COMPLETE'").agg(F.count("*").alias("chunks"), F.sum("n").alias("n_rows"), F.sum("ms").alias("ms"), F.round(F.sum("n") * 1000.0 / F.sum("ms"), 6).alias("rows_per_s"))
