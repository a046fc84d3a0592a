"""Registered projections, adapters, joins, samples and run records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import lexicon as X
from tidemark.functions.text import money
from tidemark.operators import records as R

from .events import SCORED_SQL, SESSIONS_SQL, scored, sessions
from .portfolio import EXPOSURES_SQL, exposures
from .registry import query
from .tables import table


@query("select row_number() over (order by o_orderkey) - 1 as row_id, * from orders")
def row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.row_ids(table(spark, sf_dir, "orders"), "o_orderkey")


@query("select o_orderkey as row_id, o_custkey, o_orderstatus from orders")
def existing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.existing(table(spark, sf_dir, "orders"), ["row_id", "o_custkey", "absent", "o_orderstatus", "row_id"], {"o_orderkey": "row_id"})


@query("select event_id as id, ts as created_at, event_type, user_id::varchar as author, 'events' as source from events")
def message_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages without what comes later (the value)."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), "event_type", F.col("user_id").cast("string").alias("author"), F.lit("events").alias("source"))


@query("""with r as (select event_id, case when event_id % 41 = 0 then null else event_id end id, case when event_id % 13 = 0 then '  ' else 'E' || user_id end entity, case when event_id % 17 = 0 then '' else event_type end kind, case when event_id % 19 = 0 then 'unresolved_source' else 'valid' end status, value / 19 impact, value / 100 - 0.5 sentiment from events)
select event_id, case when id is null then 'missing id' when trim(entity) = '' then 'missing entity' when kind = '' then 'missing type' when starts_with(status, 'unresolved') then 'unresolved' when impact not between 1 and 10 then 'impact out of range' when sentiment not between -1 and 1 then 'sentiment out of range' end reject_reason from r""")
def adapter_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    when = lambda k, bad, good: F.when(F.col("event_id") % k == 0, bad).otherwise(good)
    rows = table(spark, sf_dir, "events").select(
        "event_id", when(41, None, F.col("event_id")).alias("id"), when(13, "  ", F.concat(F.lit("E"), "user_id")).alias("entity"), when(17, "", F.col("event_type")).alias("event_type"),
        when(19, "unresolved_source", "valid").alias("status"), (F.col("value") / 19).alias("impact"), (F.col("value") / 100 - 0.5).alias("sentiment"),
    )
    return R.adapted(rows).select("event_id", "reject_reason")


@query("with s as (select page_id, '[''' || replace(url, '/', ''', ''') || ''']' as t from pages) select page_id, len(string_split(t, ''', ''')) as parts, string_split(t[3:-3], ''', ''')[1] as first from s")
def list_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("['"), F.replace(F.col("url"), F.lit("/"), F.lit("', '")), F.lit("']"))
    items = R.list_literal(t)
    return table(spark, sf_dir, "pages").select("page_id", F.size(items).cast("long").alias("parts"), F.get(items, F.lit(0)).alias("first"))


@query("select page_id, trim(case when page_id % 3 = 0 then regexp_extract(html, '<title>([^<]*)</title>', 1) else html end) as text, case when page_id % 2 = 0 then regexp_extract(url, '^https?://([^/:?]+)', 1) else 'publisher' || page_id % 5 end as author from pages where trim(case when page_id % 3 = 0 then regexp_extract(html, '<title>([^<]*)</title>', 1) else html end) <> ''")
def news_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Body before title, publisher before domain; rows without a text go."""
    k = F.col("page_id")
    body, publisher = F.when(k % 3 != 0, F.col("html")), F.when(k % 2 != 0, F.concat(F.lit("publisher"), k % 5))
    text = R.filled(body, F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    return table(spark, sf_dir, "pages").select("page_id", text.alias("text"), R.filled(publisher, F.regexp_extract("url", "^https?://([^/:?]+)", 1)).alias("author")).filter("text is not null")


@query("select conv_id, turn, case when trim(role) = 'user' then 'user ' || trim(text) else trim(text) end as text, md5(trim(text)) as text_md5, coalesce(case when turn = 0 then null else turn end, conv_id) as row_id from conversations where trim(text) <> ''")
def simulation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headline and body in one text, numbered by the conversation where a turn has no number; empty ones are rejected."""
    headline = F.when(F.trim("role") == "user", F.lit("user"))
    row = F.coalesce(F.when(F.col("turn") != 0, F.col("turn")), F.col("conv_id"))
    return table(spark, sf_dir, "conversations").filter(F.trim("text") != "").select("conv_id", "turn", R.joined(headline, F.col("text")).alias("text"), F.md5(F.trim("text")).alias("text_md5"), row.alias("row_id"))


@query("with l as (select l_orderkey, l_partkey, l_linenumber, l_suppkey, l_extendedprice, row_number() over (partition by l_orderkey order by l_linenumber, l_extendedprice, l_partkey, l_suppkey) k from lineitem) select o_orderkey, l_partkey, l_extendedprice from orders left join l on o_orderkey = l_orderkey and k = 1")
def first_line_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left join after the right side is brought to one row a key."""
    line = R.first_of_each(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey"), ["l_orderkey"], ["l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey"])
    o = table(spark, sf_dir, "orders")
    return o.join(line, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "l_partkey", "l_extendedprice")


@query("select count(*) n_rows, count(toxic) n_matched, count(*) - count(toxic) n_unmatched from documents d left join labels l on d.doc_id = l.doc_id")
def prediction_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return j.agg(F.count("*").alias("n_rows"), F.count("toxic").alias("n_matched"), (F.count("*") - F.count("toxic")).alias("n_unmatched"))


@query(f"with {SCORED_SQL} select event_id, kind, impact from tiered where materiality = 'MATERIAL_EVENT' and impact >= 1 and kind in ('Credit Event', 'Merger & Acquisition') order by impact desc, event_id limit 1")
def strongest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir).filter((F.col("materiality") == "MATERIAL_EVENT") & (F.col("impact") >= 1) & F.col("kind").isin("Credit Event", "Merger & Acquisition"))
    return s.orderBy(F.desc("impact"), "event_id").limit(1).select("event_id", "kind", "impact")


@query(f"with {EXPOSURES_SQL} select exposure_id, obligor, ead::double ead from exposures order by ead desc, exposure_id")
def sorted_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exposures(spark, sf_dir).select("exposure_id", "obligor", F.col("ead").cast("double").alias("ead")).orderBy(F.desc("ead"), "exposure_id")


@query(f"with {SESSIONS_SQL} select user_id, event_type, cluster::bigint as cluster, count(*) n, arg_min(event_id, (ts, event_id)) first_event from s group by all order by n desc, user_id, event_type, cluster limit 20")
def top_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest clusters with their earliest member."""
    g = sessions(spark, sf_dir).groupBy("user_id", "event_type", F.col("cluster").cast("long").alias("cluster")).agg(F.count("*").alias("n"), F.min_by("event_id", F.struct("ts", "event_id")).alias("first_event"))
    return g.orderBy(F.desc("n"), "user_id", "event_type", "cluster").limit(20)


@query("select doc_id from documents order by md5('42:' || doc_id), doc_id limit 50")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sampled(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 50)


@query("select event_id, value >= 500 as high from events order by value >= 500 desc, md5('7:' || event_id), event_id limit 100")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All high values first, filled up at random."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("value") >= 500).alias("high"))
    return R.sampled(e, "event_id", 100, 7, F.col("high"))


@query("with b as (select doc_id, ('0x' || substr(md5('42:' || md5(text)), 1, 8))::bigint % 100 b from documents) select doc_id, case when b < 70 then 'train' when b < 85 then 'val' else 'test' end split from b")
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts go into one split."""
    return table(spark, sf_dir, "documents").select("doc_id", R.split_name(F.md5("text")).alias("split"))


@query("select event_id run_id, ts created_at, case when event_id % 5 = 0 or event_id % 5 = 1 then 'FAILED' else 'COMPLETED' end status, case when event_id % 5 < 2 then 'interrupted' end error from events order by ts desc, event_id")
def recovered_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by date, the interrupted ones failed."""
    k = F.col("event_id") % 5
    runs = table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.col("ts").alias("created_at"), F.when(k == 0, "PENDING").when(k == 1, "RUNNING").otherwise("COMPLETED").alias("status"), F.lit(None).cast("string").alias("error"))
    return R.recovered(runs).orderBy(F.desc("created_at"), "run_id")


@query("""with c as (select event_id run_id, 'S' || (event_id // 2) * 2 + case when event_id % 3 = 0 then 1 else event_id % 2 end signal_id, case when event_id % 7 = 0 then 'RUNNING' else 'COMPLETED' end status, event_id % 11 shape from events),
old as (select event_id run_id, 'S' || event_id signal_id from events where event_id % 4 = 0)
select c.run_id, c.signal_id, case when status <> 'COMPLETED' then 'rejected: status' when shape < 1 then 'rejected: shape' when a.signal_id = c.signal_id then 'unchanged' when a.signal_id is not null or b.run_id is not null then 'rejected: collision' else 'promoted' end outcome from c left join old a on c.run_id = a.run_id left join old b on c.signal_id = b.signal_id""")
def promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    signal = F.concat(F.lit("S"), (F.expr("event_id div 2") * 2 + F.when(k % 3 == 0, 1).otherwise(k % 2)).cast("string"))
    c = e.select(k.alias("run_id"), signal.alias("signal_id"), F.when(k % 7 == 0, "RUNNING").otherwise("COMPLETED").alias("status"), (k % 11).alias("shape"))
    return R.promoted(c, e.filter(k % 4 == 0).select(k.alias("run_id"), F.concat(F.lit("S"), k.cast("string")).alias("signal_id")))


@query("select doc_id, max(origin) origin from (select doc_id, 'labels' origin from labels union all select doc_id, 'documents' from documents) group by doc_id")
def union_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "labels").select("doc_id", F.lit("labels").alias("origin")).unionByName(table(spark, sf_dir, "documents").select("doc_id", F.lit("documents").alias("origin")))
    return R.first_of_each(both, ["doc_id"], [F.when(F.col("origin") == "labels", 0).otherwise(1)])


@query("select doc_id from documents intersect select doc_id from labels")
def labelled_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").intersect(table(spark, sf_dir, "labels").select("doc_id"))


_KINDS = ["Credit event ", "regulatory/legal", "MERGER &amp; ACQUISITION", "rumour", "Market/Liquidity"]
_SPELLED = "case lower(trim(k)) " + " ".join(f"when '{a}' then '{b}'" for a, b in X.SPELLINGS.items()) + " else k end"


@query(f"with k as (select event_id, [{', '.join(repr(k) for k in _KINDS)}][event_id % 5 + 1] k from events) select event_id, {_SPELLED} as event_type from k")
def canonical_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    spelled = F.create_map(*[F.lit(x) for pair in X.SPELLINGS.items() for x in pair])
    k = F.get(F.lit(_KINDS), (F.col("event_id") % 5).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.try_element_at(spelled, F.lower(F.trim(k))), k).alias("event_type"))


@query("""with m as (select o_orderkey, o_totalprice * [1.00073::double, -0.00107, 1000.37, -100000.9][o_orderkey % 4 + 1] x from orders), s as (select *, abs(x) a from m)
select o_orderkey, (case when x < 0 then '-' else '' end) || case when a >= 1e9 then format('${:,.3f}B', a / 1e9) when a >= 1e6 then format('${:,.3f}M', a / 1e6) when a >= 1e3 then format('${:,.3f}K', a / 1e3) else format('${:,.2f}', a) end amount from s""")
def money_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = F.get(F.lit([1.00073, -0.00107, 1000.37, -100000.9]), (F.col("o_orderkey") % 4).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", money(F.col("o_totalprice") * times).alias("amount"))


@query(f"with {SCORED_SQL} select event_id, concat_ws('; ', kind || ' scored ' || tier, case when sentiment < 0 then 'negative sentiment' end, case when mm > 1 then 'market confirms' when mm < 1 then 'market is calm' end, case when novelty < 1 then 'seen before' end) explanation, concat_ws(chr(10), 'event ' || event_id, 'type ' || kind, 'tier ' || tier) trace from tiered")
def explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, m = scored(spark, sf_dir), F.col("market_modifier")
    why = F.concat_ws("; ", F.concat("kind", F.lit(" scored "), "tier"), F.when(F.col("sentiment") < 0, "negative sentiment"), F.when(m > 1, "market confirms").when(m < 1, "market is calm"), F.when(F.col("novelty") < 1, "seen before"))
    trace = F.concat_ws("\n", F.concat(F.lit("event "), "event_id"), F.concat(F.lit("type "), "kind"), F.concat(F.lit("tier "), "tier"))
    return s.select("event_id", why.alias("explanation"), trace.alias("trace"))


@query("select event_id, json_extract_string(props, '$.k')::bigint k, '{\"event\":' || event_id || ',\"type\":\"' || event_type || '\"}' payload from events")
def payload_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.to_json(F.struct(F.col("event_id").alias("event"), F.col("event_type").alias("type")))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), payload.alias("payload"))


@query("with s as (select event_id, (event_id % 11) / 5.0::double a, (event_id % 7) / 3.0::double b, (event_id % 5) / 2.0::double c from events), m as (select *, greatest(a, b, c) t from s) select event_id, case t when a then 'negative' when b then 'neutral' else 'positive' end as label, round(1 / (exp(a - t) + exp(b - t) + exp(c - t)), 9) probability from m")
def softmax_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda m, by: (F.col("event_id") % m).cast("double") / by
    s = table(spark, sf_dir, "events").select("event_id", R.softmax_label({"negative": d(11, 5.0), "neutral": d(7, 3.0), "positive": d(5, 2.0)}).alias("s"))
    return s.select("event_id", "s.label", F.round("s.probability", 9).alias("probability"))


@query("select user_id as ticker, min(ts) first_ts, max(ts) last_ts, count(*) n from events group by 1")
def cache_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("ticker")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))


@query("with t as (select distinct user_id from events), r as (select user_id, count(*) n, sum((value * 100)::bigint) total from events where ts >= timestamp '2024-01-05' and ts <= timestamp '2024-01-12' group by 1) select t.user_id as ticker, coalesce(n, 0) n, total, case when n is null then 'no data' else 'success' end status from t left join r on t.user_id = r.user_id")
def range_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pushed-down time range, with a status for instruments that have nothing in it."""
    e = table(spark, sf_dir, "events")
    inside = e.filter((F.col("ts") >= F.lit("2024-01-05").cast("timestamp")) & (F.col("ts") <= F.lit("2024-01-12").cast("timestamp")))
    r = inside.groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("total"))
    return e.select("user_id").distinct().join(r, "user_id", "left").select(F.col("user_id").alias("ticker"), F.coalesce("n", F.lit(0)).alias("n"), "total", F.when(F.col("n").isNull(), "no data").otherwise("success").alias("status"))


@query("""with e as (select event_id, user_id, ts from events where event_type = 'error'), b as (select user_id, ts, arg_max(value, event_id) v from events where event_type <> 'error' group by all),
o as (select e.*, b.v, b.ts as seen from e asof left join b on e.user_id = b.user_id and e.ts >= b.ts)
select o.event_id, o.user_id, o.v as before, n.v as after from o asof left join b n on o.user_id = n.user_id and o.seen + interval 1 hour <= n.ts""")
def around_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value each error falls on, and the first one an hour after that value or later."""
    e = table(spark, sf_dir, "events")
    bars = e.filter("event_type <> 'error'").groupBy("user_id", "ts").agg(F.max_by("value", "event_id").alias("value"))
    return R.around(e.filter("event_type = 'error'"), bars, "user_id", "ts", "ts", "value").select("event_id", "user_id", "before", "after")


_FUNDS = ", ".join(f"('{a}', '{b}')" for a, b in X.SECTOR_FUNDS.items())


@query(f"""with f(sector, fund) as (values {_FUNDS}), s as (select user_id, ts, event_id, value, ['Energy', ' technology', 'Unknown', 'Health care', 'CONS DISC'][user_id % 5 + 1] sector from events),
d as (select fund, cast(ts as date) d, avg(value::decimal(18,2)) v from s join f on f.sector = lower(trim(s.sector)) group by all) select fund, d as trade_date, round(v, 6) as level, round(v / lag(v) over (partition by fund order by d) - 1, 6) movement from d""")
def sector_movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily movement of the fund that stands for each sector; unknown sectors have none."""
    funds = F.create_map(*[F.lit(x) for pair in X.SECTOR_FUNDS.items() for x in pair])
    sector = F.get(F.lit(["Energy", " technology", "Unknown", "Health care", "CONS DISC"]), (F.col("user_id") % 5).cast("int"))
    e = table(spark, sf_dir, "events").select(F.try_element_at(funds, F.lower(F.trim(sector))).alias("fund"), F.to_date("ts").alias("trade_date"), F.col("value").cast("decimal(18,2)").alias("v")).filter("fund is not null")
    d = e.groupBy("fund", "trade_date").agg((F.sum("v").cast("double") / F.count("*")).alias("v"))
    return d.select("fund", "trade_date", F.round("v", 6).alias("level"), F.round(F.col("v") / F.lag("v").over(Window.partitionBy("fund").orderBy("trade_date")) - 1, 6).alias("movement"))


@query("select event_id, case when event_id % 3 = 0 then 'SOURCE_' || user_id when event_id % 7 = 0 then 'UNRESOLVED_' || event_id else 'E' || user_id end entity_key from events")
def cluster_entity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, user = F.col("event_id"), F.col("user_id").cast("string")
    return table(spark, sf_dir, "events").select("event_id", F.when(k % 3 == 0, F.concat(F.lit("SOURCE_"), user)).when(k % 7 == 0, F.concat(F.lit("UNRESOLVED_"), k.cast("string"))).otherwise(F.concat(F.lit("E"), user)).alias("entity_key"))


@query(f"with {SCORED_SQL}, x as (select event_id, case when event_id % 9 = 0 then 1.0::double else mm end m, raw / mm base from raws) select event_id, base * m enriched, base plain, base * m <> base changed from x")
def enriched_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with the market's modifier; where there is no context it is 1."""
    s = scored(spark, sf_dir)
    base = F.col("raw") / F.col("market_modifier")
    m = F.when(F.col("event_id") % 9 == 0, 1.0).otherwise(F.col("market_modifier"))
    x = s.select("event_id", base.alias("base"), m.alias("m"))
    return x.select("event_id", (F.col("base") * F.col("m")).alias("enriched"), F.col("base").alias("plain"), (F.col("base") * F.col("m") != F.col("base")).alias("changed"))


@query("with r as (select doc_id, contains(lower(text), 'license') as relevant, n_chars from documents) select doc_id, relevant, case when relevant then case when n_chars > 1000 then 'Regulatory / Legal' else 'Other / Unclear' end else 'NO_EVENT' end as event_type from r")
def two_stage_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types only for relevant rows, brought back to all rows."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").contains("license").alias("relevant"), "n_chars")
    typed = d.filter("relevant").select("doc_id", F.when(F.col("n_chars") > 1000, "Regulatory / Legal").otherwise("Other / Unclear").alias("event_type"))
    return d.join(typed, "doc_id", "left").select("doc_id", "relevant", F.coalesce("event_type", F.lit("NO_EVENT")).alias("event_type"))


@query(f"with {EXPOSURES_SQL}, r as (select case when pd >= 0.02 then 'B' when pd >= 0.005 then 'BBB' else 'AA' end rating, ead from exposures) select rating, count(*) n, sum(ead)::double ead, round(100 * sum(ead)::double / (select sum(ead) from r)::double, 2) pct from r group by rating")
def rating_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rating = F.when(F.col("pd") >= 0.02, "B").when(F.col("pd") >= 0.005, "BBB").otherwise("AA")
    g = exposures(spark, sf_dir).groupBy(rating.alias("rating")).agg(F.count("*").alias("n"), F.sum("ead").alias("ead"))
    total = F.sum("ead").over(Window.partitionBy())  # a row a rating
    return g.select("rating", "n", F.col("ead").cast("double").alias("ead"), F.round(100 * F.col("ead").cast("double") / total.cast("double"), 2).alias("pct"))
