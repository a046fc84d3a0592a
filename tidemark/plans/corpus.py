"""Reference queries over documents, pages, conversations and dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import lexicon as X
from tidemark.functions.text import title_key
from tidemark.operators import ingest, rules

from .registry import query
from .tables import table

#: Keywords taken from the corpus' own vocabulary, next to the financial list.
OWN = ["license", "idiot", "copyright", "rights reserved"]
_WORDS = "|".join(w.replace(".", "\\.") for w in [*X.KEYWORDS, *OWN])


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    text = F.lower(F.coalesce(F.col("text"), F.lit("")))
    signals = {"keyword": ingest.any_substring(text, [*X.KEYWORDS, *OWN]), "source": F.col("source").isin("src0", "src1", "src2"), "long": F.coalesce(F.col("n_chars"), F.lit(0)) > 5000}
    return ingest.candidate_filter(d, signals)


_CAND = f"""cand as (select doc_id, lang, source, regexp_matches(lower(coalesce(text, '')), '{_WORDS}') as kw, coalesce(source in ('src0', 'src1', 'src2'), false) as src, coalesce(n_chars, 0) > 5000 as lng from documents),
rs as (select *, concat_ws(' + ', case when kw then 'keyword' end, case when lng then 'long' end, case when src then 'source' end) as combo, kw or src or lng as kept from cand)"""


@query(f"with {_CAND} select doc_id, kept, combo as reasons from rs")
def candidate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select("doc_id", "kept", F.array_join(F.array_sort("reasons"), " + ").alias("reasons"))


@query(f"with {_CAND} select combo as reasons, count(*) n from rs group by combo")
def reason_combos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).groupBy(F.array_join(F.array_sort("reasons"), " + ").alias("reasons")).agg(F.count("*").alias("n"))


@query(f"with {_CAND} select doc_id from rs where kw")
def keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(ingest.any_substring(F.lower("text"), [*X.KEYWORDS, *OWN])).select("doc_id")


@query("select doc_id, lang from documents where lower(lang) = 'en'")
def language_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(F.lower("lang") == "en").select("doc_id", "lang")


@query(f"with {_CAND}, j as (select kept, toxic = 1 as y from rs join labels using (doc_id)), m as (select count(*) filter (kept and y) tp, count(*) filter (kept and not y) fp, count(*) filter (not kept and y) fn, count(*) n from j) select tp, fp, fn, tp::double / nullif(tp + fn, 0) as recall, tp::double / nullif(tp + fp, 0) as precision, (tp + fp)::double / n as candidate_rate from m")
def filter_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _candidates(spark, sf_dir).select("doc_id", "kept").join(table(spark, sf_dir, "labels"), "doc_id")
    n = lambda cond, name: F.count(F.when(F.expr(cond), 1)).alias(name)
    m = j.agg(n("kept and toxic = 1", "tp"), n("kept and toxic <> 1", "fp"), n("not kept and toxic = 1", "fn"), F.count("*").alias("n"))
    div = lambda a, b: F.try_divide(F.expr(a).cast("double"), F.expr(b))
    return m.select("tp", "fp", "fn", div("tp", "tp + fn").alias("recall"), div("tp", "tp + fp").alias("precision"), div("tp + fp", "n").alias("candidate_rate"))


@query("with t as (select unnest(range(2, 19)) * 0.05::double as threshold), j as (select (doc_id % 100) / 100.0::double as score, toxic from documents join labels using (doc_id)) select round(threshold, 2) threshold, count(*) filter (score >= threshold and toxic = 1) tp, count(*) filter (score >= threshold and toxic <> 1) fp, count(*) filter (score < threshold and toxic = 1) fn from t, j group by threshold")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score histogram first, then 17 thresholds over its bins: the rows are not multiplied."""
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    h = j.groupBy((F.expr("doc_id % 100").cast("double") / 100.0).alias("score"), (F.col("toxic") == 1).alias("y")).agg(F.count("*").alias("n"))
    t = h.withColumn("threshold", F.explode(F.transform(F.sequence(F.lit(2), F.lit(18)), lambda k: k * 0.05)))
    n = lambda cond, name: F.sum(F.when(F.expr(cond), F.col("n")).otherwise(0)).alias(name)
    return t.groupBy(F.round("threshold", 2).alias("threshold")).agg(n("score >= threshold and y", "tp"), n("score >= threshold and not y", "fp"), n("score < threshold and y", "fn"))


@query("""with recursive o as (select doc_id, row_number() over (order by doc_id) n, ['0:' || source || n_chars, '1:' || md5(text), '2:' || lang || '_' || (n_chars // 3)] as ks from documents),
r(n, doc_id, seen, keep) as (select 0::bigint, null::bigint, []::varchar[], false union all select o.n, o.doc_id, case when list_has_any(seen, ks) then seen else list_concat(seen, ks) end, not list_has_any(seen, ks) from r join o on o.n = r.n + 1)
select doc_id from r where keep""")
def dedupe_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three keys in the order of arrival; the SQL is the loop over the rows."""
    d = table(spark, sf_dir, "documents")
    keys = [F.concat("source", "n_chars"), F.md5("text"), F.concat_ws("_", "lang", F.expr("n_chars div 3"))]
    return ingest.first_seen(d, keys, "doc_id").select("doc_id")


@query("select md5(text) as content_hash, count(*) n, count(distinct source) sources, count(distinct lang) langs, min(doc_id) first_id from documents group by text having count(*) > 1")
def duplicate_text_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("content_hash"), "source", "lang")
    g = d.groupBy("content_hash").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"), F.count_distinct("lang").alias("langs"), F.min("doc_id").alias("first_id"))
    return g.filter("n > 1")


@query("select page_id, sha256(url || html) as document_id, md5(html) as html_hash, regexp_extract(url, '^https?://([^/:?]+)', 1) as domain, regexp_extract(url, '^https?://([^/:?]+)', 1) like '%.example.com' as trusted from pages")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    domain = F.regexp_extract("url", "^https?://([^/:?]+)", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(F.concat("url", "html").cast("binary"), 256).alias("document_id"), F.md5("html").alias("html_hash"), domain.alias("domain"), domain.endswith(".example.com").alias("trusted"))


@query("select page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) as title from pages")
def title_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


@query("select regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') as title_key, count(*) n from part group by 1")
def title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(title_key(F.col("p_name")).alias("title_key")).agg(F.count("*").alias("n"))


_BARE = f"trim(regexp_replace(regexp_replace(low, '\\b({'|'.join(X.SUFFIXES)})\\.?$', ''), '[^\\w\\s]', '', 'g'))"
_SOURCES = ", ".join(f"'{p}'" for p in X.PUBLISHERS)


@query(f"""with names as (select c_custkey, case c_custkey % 6 when 0 then c_name when 1 then upper(c_name) || ' Inc.' when 2 then ' Reuters ' when 3 then '' when 4 then null else 'Other ' || c_custkey::varchar end as name from customer),
al as (select lower(alias) as k, arg_min(c_name, c_custkey) as canonical, min(c_custkey) as entity_id from (select c_custkey, c_name, c_name as alias from customer union all select c_custkey, c_name, replace(c_name, '#', '') from customer) group by 1),
l as (select *, trim(coalesce(name, '')) as said, lower(trim(coalesce(name, ''))) as low from names), b as (select *, {_BARE} as bare, low in ({_SOURCES}) as source from l),
j as (select b.*, e.entity_id as eid, n.entity_id as nid, coalesce(e.canonical, n.canonical) as canon from b left join al e on low = e.k and not source and said <> '' left join al n on bare = n.k and not source and said <> '')
select c_custkey, name, coalesce(eid, nid) as entity_id, case when source or said = '' then '' else coalesce(canon, said) end as canonical, case when source then 'unresolved_source' when coalesce(eid, nid) is not null then 'valid' else 'unresolved_entity' end as status, case when eid is not null then 1.0::double when nid is not null then 0.85::double else 0.0::double end as confidence from j""")
def entity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publisher, alias, bare name, fallback: each customer is its own entity with two aliases."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    name = F.when(k % 6 == 0, F.col("c_name")).when(k % 6 == 1, F.concat(F.upper("c_name"), F.lit(" Inc."))).when(k % 6 == 2, " Reuters ").when(k % 6 == 3, "").when(k % 6 == 5, F.concat(F.lit("Other "), k.cast("string")))
    aliases = c.select(F.explode(F.array("c_name", F.replace("c_name", F.lit("#"), F.lit("")))).alias("alias"), k.alias("entity_id"), F.col("c_name").alias("canonical"))
    return ingest.resolve(c.select("c_custkey", name.alias("name")), "name", aliases)


#: Entities of the funnel and the phrases they are known by.
KNOWN = {"general public license": "gpl", "all rights reserved": "owner", "you idiot": "insult"}
_NAMED = " or ".join(f"contains(' ' || lower(coalesce(text, '')) || ' ', ' {a} ')" for a in KNOWN)


@query(f"""with s as (select doc_id, {_NAMED} as e, coalesce(source in ('src0', 'src1'), false) as d, regexp_matches(lower(coalesce(text, '')), '{_WORDS}') as k, (doc_id % 100) / 100.0::double as score from documents)
select doc_id, case when e or d or k then concat_ws(' + ', case when e then 'ENTITY' end, case when d then 'DOMAIN' end, case when k then 'KEYWORD' end) when score >= 0.3 then 'SEMANTIC' else '' end as reasons, e or d or k or score >= 0.3 as kept from s""")
def funnel_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities contained in the text, source and keywords; the score decides only about rows without any of them."""
    d = table(spark, sf_dir, "documents")
    text = F.lower(F.coalesce(F.col("text"), F.lit("")))
    signals = {"ENTITY": ingest.names_any(text, list(KNOWN)), "DOMAIN": F.col("source").isin("src0", "src1"), "KEYWORD": ingest.any_substring(text, [*X.KEYWORDS, *OWN])}
    kept = ingest.candidate_filter(d, signals, (F.col("doc_id") % 100).cast("double") / 100.0)
    return kept.select("doc_id", F.array_join("reasons", " + ").alias("reasons"), "kept")


@query("with al as (select distinct p_name as alias, regexp_extract(p_name, '[^ ]+$') as entity_id from part) select p_partkey, string_agg(distinct entity_id, ',' order by entity_id) as entities from part join al on contains(' ' || p_name || ' ' || lower(p_type) || ' ', ' ' || alias || ' ') group by p_partkey")
def alias_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    aliases = p.select(F.col("p_name").alias("alias"), F.regexp_extract("p_name", "[^ ]+$", 0).alias("entity_id")).distinct()
    return ingest.alias_scan(p, "p_partkey", F.concat_ws(" ", "p_name", F.lower("p_type")), aliases, longest=3)


# ---- rule cascades over literal texts and all documents ----
# Sentences whose outcome is known.
TEXTS = [
    ("Oracle buys Apiary to build its cloud platform", "Merger & Acquisition", 0.9), ("If the merger goes ahead we all lose", "Merger & Acquisition", 0.9), ("if it buys 19.5% stake", "Merger & Acquisition", 0.5),
    ("Acme filed for bankruptcy", "Credit Event", 0.4), ("you might go bankrupt soon", "Credit Event", 0.4), ("Fed likely to keep rates steady", "Other / Unclear", 0.3), ("check out this cheap phone on ebay", "Product / Technology", 0.6),
    ("I think the stock will fall", "Market / Liquidity", 0.6), ("boycott the shop, it was fined", "Other / Unclear", 0.5), ("boycott the shop", "Other / Unclear", 0.5), ("IPO", "Corporate / Earnings", 0.1), ("coup", "Geopolitical", 0.1),
    ("gold ring on the commodity market", "Commodity / Supply Chain", 0.8), ("shares plunged after the outage", "Product / Technology", 0.7), ("", "Credit Event", 0.9), ("my debt is high", "Credit Event", 0.9), ("Acme announces debt restructuring", "Regulatory / Legal", 0.8),
]
# Sentences whose outcome is known.
GUARDED = [
    ("Ford defaults on loan, debt restructuring", "Ford", "valid", "Credit Event"), ("Covenant breach by Acme", "Acme", "valid", "Credit Event"), ("Moody's announces credit downgrade for Acme", "Acme", "valid", "Credit Event"),
    ("How to change the default browser on Mac", "Mac", "valid", "Credit Event"), ("Change the default settings", "Acme", "valid", "Credit Event"), ("I support Christine Ford's testimony.", "Ford", "valid", "Credit Event"),
    ("Walt Disney was a visionary", "Disney", "valid", "Credit Event"), ("Applying for an F-1 visa", "Visa", "valid", "Credit Event"), ("Reuters missed payment", "Reuters", "unresolved_source", "Credit Event"), ("Acme announces new product", "Acme", "valid", "Product / Technology"), ("Acme is fine", "Acme", "valid", "Credit Event"),
]
_TYPES = list(X.RULES)
_q = lambda s: s.replace("'", "''")
_any = lambda ps: "regexp_matches(t, '(?i)" + _q("|".join(f"(?:{p})" for p in ps)) + "')"
_first = lambda ps: "coalesce(" + ", ".join(f"nullif(regexp_extract(t, '(?i){_q(p)}'), '')" for p in ps) + ")"


def _materiality_sql() -> str:
    cols = []
    for k, name in enumerate(_TYPES):
        cols.append(f"case when {_any(X.RULES[name])} then {_first(X.RULES[name])} end as hit{k}")
        sup = f"case when {_any(X.TYPE_SUPPRESS[name])} then '{X.SUPPRESSED[name]}' end" if name in X.TYPE_SUPPRESS else "null::varchar"
        if name == "Merger & Acquisition":
            sup = f"coalesce({sup}, case when regexp_matches(t, '(?i)^if\\b') and not {_any(X.DEAL_SIGN)} then 'conditional_framing' end)"
        cols.append(f"{sup} as sup{k}")
    own = lambda c: "case event_type " + " ".join(f"when '{_q(n)}' then {c}{k}" for k, n in enumerate(_TYPES)) + " end"
    weak = lambda h: f"(confidence < 0.20 and length({h}) < 9 and not regexp_matches({h}, '\\d'))"
    n = lambda reason: f"['NON_MATERIAL_FINANCIAL_CONTENT', 'NO_EVENT', {reason}]"
    i = _TYPES.index
    whens = [("relevance <> 'FINANCIAL_EVENT'", "['NO_EVENT', 'NO_EVENT', 'relevance_gate']"), ("t = ''", n("'empty_text'")), (_any(X.LISTING_SUPPRESS), n("'consumer_listing_context'")), (_any(X.PERSONAL_FINANCE_SUPPRESS), n("'personal_finance_context'")), (_any(X.PERSONAL_INTENT_SUPPRESS), n("'personal_intent_statement'"))]
    whens += [(f"{_any(X.OPINION_SUPPRESS)} and own_hit is null", n("'opinion_or_prediction_framing'")), (f"{_any(X.BOYCOTT_SUPPRESS)} and hit{i('Regulatory / Legal')} is null", n("'boycott_or_activism_framing'")), (f"{_any(X.PERSONAL_CREDIT_SUPPRESS)} and hit{i('Credit Event')} is null", n("'personal_credit_complaint'"))]
    whens += [("own_sup is not null", n("own_sup")), (f"own_hit is not null and not {weak('own_hit')}", "['MATERIAL_EVENT', event_type, 'upstream_type_confirmed:' || own_hit]")]
    whens += [(f"event_type <> '{_q(name)}' and sup{k} is null and hit{k} is not null and not {weak(f'hit{k}')}", f"['MATERIAL_EVENT', '{_q(name)}', 'rescued_cross_type:{_q(name)}:' || hit{k}]") for k, name in enumerate(_TYPES)]
    lits = ", ".join(f"({-k - 1}, '{_q(a)}', '{b}', {c}::double)" for k, (a, b, c) in enumerate(TEXTS))
    kinds = "[" + ", ".join(f"'{_q(x)}'" for x in [*_TYPES, "Other / Unclear"]) + "]"
    return f"""with rows(id, text, event_type, confidence, relevance) as (select *, 'FINANCIAL_EVENT' from (values {lits}) union all select doc_id, text, {kinds}[(doc_id % 10) + 1], 0.15::double + (doc_id % 80) / 100.0::double, case when lang = 'en' then 'FINANCIAL_EVENT' else 'OTHER' end from documents),
    c as (select *, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) as t from rows), h as (select *, {", ".join(cols)} from c), o as (select *, {own("hit")} as own_hit, {own("sup")} as own_sup from h),
    v as (select id, case {" ".join(f"when {a} then {b}" for a, b in whens)} else {n("'no_sufficient_event_evidence'")} end as v from o) select id, v[1] as materiality, v[2] as final_type, v[3] as reason from v"""


@query(_materiality_sql())
def materiality(spark: SparkSession, sf_dir: str) -> DataFrame:
    lit = spark.createDataFrame([(-k - 1, *t) for k, t in enumerate(TEXTS)], "id long, text string, event_type string, confidence double")
    kinds = F.lit([*_TYPES, "Other / Unclear"])
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.get(kinds, (F.col("doc_id") % 10).cast("int")).alias("event_type"), (F.lit(0.15) + (F.col("doc_id") % 80).cast("double") / 100.0).alias("confidence"), F.when(F.col("lang") == "en", "FINANCIAL_EVENT").otherwise("OTHER").alias("relevance"))
    rows = lit.withColumn("relevance", F.lit("FINANCIAL_EVENT")).unionByName(d)
    return rules.materiality(rows, "text", "event_type", "relevance", "confidence").select("id", "materiality", "final_type", "reason")


_GLITS = ", ".join(f"({-k - 1}, '{_q(a)}', '{b}', '{c}', '{d}')" for k, (a, b, c, d) in enumerate(GUARDED))
_like = lambda *w: "(" + " or ".join(f"contains(t, '{x}')" for x in w) + ")"


@query(f"""with r(id, text, entity, status, event_type) as (select * from (values {_GLITS}) union all select doc_id, text, 'Acme', 'valid', 'Credit Event' from documents), l as (select *, lower(coalesce(text, '')) t, lower(entity) e from r),
g as (select id, case when event_type <> 'Credit Event' then 'NOT_APPLICABLE' when {_any(X.WEAK_CONTEXTS)} then 'LEXICAL_COLLISION' when status = 'unresolved_source' then 'ENTITY_COLLISION_PUBLISHER' when e = 'ford' and {_like("christine ", "rob ", "doug ", "tom ")} then 'ENTITY_COLLISION_PERSON'
when e = 'disney' and {_like("walt disney")} then 'ENTITY_COLLISION_PERSON' when e = 'visa' and {_like("f-1", "f1", "h1b", "h-1b", "tourist", "travel")} then 'ENTITY_COLLISION_CONCEPT' when not {_any(X.STRONG_TERMS)} then 'MISSING_STRONG_CREDIT_EVIDENCE' else 'PASSED' end as credit_guard_reason from l)
select id, credit_guard_reason, credit_guard_reason in ('NOT_APPLICABLE', 'PASSED') as credit_guard_pass from g""")
def credit_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    lit = spark.createDataFrame([(-k - 1, *t) for k, t in enumerate(GUARDED)], "id long, text string, entity string, status string, event_type string")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.lit("Acme").alias("entity"), F.lit("valid").alias("status"), F.lit("Credit Event").alias("event_type"))
    return rules.credit_guard(lit.unionByName(d), "text", "entity", "status", "event_type").select("id", "credit_guard_reason", "credit_guard_pass")


@query("select count(*) n, count(*) filter (text is null or trim(text) = '') empty_text, count(*) filter (n_chars <> length(text)) wrong_length, count(*) filter (lang not in ('en', 'de', 'fr', 'es')) unknown_lang, count(distinct source) sources from documents")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda cond, name: F.count(F.when(F.expr(cond), 1)).alias(name)
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("n"), n("text is null or trim(text) = ''", "empty_text"), n("n_chars <> length(text)", "wrong_length"), n("lang not in ('en', 'de', 'fr', 'es')", "unknown_lang"), F.count_distinct("source").alias("sources"))


@query("with a as (select doc_id, count(*) na from documents group by 1), b as (select doc_id, count(*) nb from labels group by 1) select count(*) filter (nb is null) missing, count(*) filter (na is null) extra, count(*) filter (na > 1) duplicate_left, count(*) filter (nb > 1) duplicate_right from a full join b using (doc_id)")
def row_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.row_identity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("select role, count(*) n, count(distinct conv_id) conversations, sum(length(text))::bigint chars, max(turn) last_turn from conversations group by role")
def conversation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.count_distinct("conv_id").alias("conversations"), F.sum(F.length("text")).alias("chars"), F.max("turn").alias("last_turn"))

