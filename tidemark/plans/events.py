"""Queries over the events table: scores, bars, windows, clusters."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scoring as S
from tidemark.functions.lexicon import COMPATIBLE
from tidemark.operators import clustering, market

from .registry import query
from .tables import table

#: event_type of the table -> (event type, materiality)
TYPES = {"error": ("Credit Event", "MATERIAL_EVENT"), "purchase": ("Merger & Acquisition", "MATERIAL_EVENT"), "signup": ("Corporate / Earnings", "MATERIAL_EVENT"), "click": ("NO_EVENT", "NON_MATERIAL_FINANCIAL_CONTENT"), "view": ("NO_EVENT", "NO_EVENT")}
_CASE = lambda k: "case event_type " + " ".join(f"when '{a}' then '{b[k]}'" for a, b in TYPES.items()) + " end"
SCORED_SQL = f"""inputs as (select event_id, {_CASE(0)} as kind, {_CASE(1)} as materiality, (event_id % 100) / 100.0::double as confidence, 0.5 + (user_id % 6) / 10.0::double as credibility,
    1.0::double / (1 + event_id % 4) as novelty, (event_id % 201 - 100) / 100.0::double as sentiment, (event_id % 61 - 30) / 1000.0::double as ar, (event_id % 37) / 10.0::double as vr, (event_id % 29) / 10.0::double as vol from events),
mods as (select *, case kind when 'Credit Event' then 1.0 when 'Merger & Acquisition' then 0.8 when 'Corporate / Earnings' then 0.7 else 0.25 end::double as sev,
    case when sentiment < 0 then 1 + 0.25::double * abs(sentiment) else 1 + 0.10::double * sentiment end as sm,
    round(greatest(0.70::double, least(1.30::double, 1.0::double + case when abs(ar) > 0.015::double then least(0.15::double, (abs(ar) - 0.015::double) * 3.0::double) when abs(ar) < 0.005::double then -0.10::double else 0.0 end
      + case when vr > 1.5::double then least(0.10::double, (vr - 1.5::double) * 0.05::double) when vr < 1 then -0.05::double else 0.0 end + case when vol > 2 then 0.05::double when vol < 1 then -0.05::double else 0.0 end)), 4) as mm from inputs),
raws as (select *, sev * round(0.70::double + 0.30::double * confidence, 4) * credibility * round(0.75::double + 0.25::double * novelty, 4) * sm * mm as raw from mods),
scored as (select *, round(case materiality when 'NO_EVENT' then 1.0::double when 'NON_MATERIAL_FINANCIAL_CONTENT' then 1 + least(1.0::double, raw / 1.2::double) else greatest(1.0::double, least(10.0::double, 1 + 9 * greatest(0.0::double, least(1.0::double, raw / 1.2::double)))) end, 2) as impact from raws),
tiered as (select *, case when impact >= 8.5 then 'Critical' when impact >= 7 then 'High' when impact >= 5 then 'Moderate' when impact >= 3 then 'Low' else 'Minimal' end as tier from scored)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = lambda k: F.create_map(*[F.lit(x) for a, b in TYPES.items() for x in (a, b[k])])[F.col("event_type")]
    d = lambda c: F.expr(c).cast("double")
    i = e.select(
        "event_id", kind(0).alias("kind"), kind(1).alias("materiality"), (d("event_id % 100") / 100.0).alias("confidence"), (F.lit(0.5) + d("user_id % 6") / 10.0).alias("credibility"),
        (1.0 / d("1 + event_id % 4")).alias("novelty"), (d("event_id % 201 - 100") / 100.0).alias("sentiment"), (d("event_id % 61 - 30") / 1000.0).alias("ar"), (d("event_id % 37") / 10.0).alias("vr"), (d("event_id % 29") / 10.0).alias("vol"),
    )
    i = i.withColumn("market_modifier", S.market_modifier(F.col("ar"), F.col("vr"), F.col("vol")))
    raw = S.raw_impact(F.col("kind"), F.col("confidence"), F.col("credibility"), F.col("novelty"), F.col("sentiment"), F.col("market_modifier"))
    i = i.withColumn("raw", raw).withColumn("impact", S.impact(F.col("materiality"), F.col("raw")))
    return i.withColumn("tier", S.tier(F.col("impact")))


@query(f"with {SCORED_SQL} select event_id, kind, materiality, round(impact, 9) as impact, tier from tiered")
def impact_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("event_id", "kind", "materiality", F.round("impact", 9).alias("impact"), "tier")


@query(f"with {SCORED_SQL} select tier, count(*) n, count(*) * 100.0::double / (select count(*) from tiered) pct from tiered group by tier")
def impact_tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = scored(spark, sf_dir).groupBy("tier").agg(F.count("*").alias("n"))
    return t.select("tier", "n", (F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy())).alias("pct"))


@query(f"with {SCORED_SQL} select count(*) filter (materiality = 'NO_EVENT' and impact > 1) no_event_above_1, count(*) filter (materiality = 'NON_MATERIAL_FINANCIAL_CONTENT' and impact > 2) non_material_above_2, count(*) filter (materiality <> 'MATERIAL_EVENT' and impact >= 7) non_material_high from tiered")
def gating_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda cond, name: F.count(F.when(F.expr(cond), 1)).alias(name)
    return scored(spark, sf_dir).agg(n("materiality = 'NO_EVENT' and impact > 1", "no_event_above_1"), n("materiality = 'NON_MATERIAL_FINANCIAL_CONTENT' and impact > 2", "non_material_above_2"), n("materiality <> 'MATERIAL_EVENT' and impact >= 7", "non_material_high"))


@query(f"with {SCORED_SQL} select event_id, round(mm, 9) market_modifier from mods")
def market_modifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("event_id", F.round("market_modifier", 9).alias("market_modifier"))


BARS_SQL = """bars as (select user_id as ticker, cast(ts as date) as trade_date, arg_max(value, (ts, event_id)) as close, count(*) as volume from events group by all),
idx as (select trade_date, avg(cast(close as decimal(18,2))) as index_close from bars group by trade_date)"""


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.daily_bars(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "value")


@query(f"with {BARS_SQL} select * from bars")
def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir)


@query(f"with {BARS_SQL}, ev as (select event_id, user_id as ticker, cast(ts as date) - 1 as event_date from events) select event_id, ev.ticker, event_date, trade_date as anchor_date, close as anchor_close from ev asof left join bars on ev.ticker = bars.ticker and ev.event_date >= bars.trade_date")
def asof_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("ticker"), F.date_sub(F.to_date("ts"), 1).alias("event_date"))
    return market.as_of(e, bars(spark, sf_dir))


@query(f"""with {BARS_SQL}, j as (select b.*, index_close, case when close > 0 and lag(close) over l > 0 then ln(close / lag(close) over l) end as lr, lag(close) over l as prior, lag(index_close) over l as ip, count(*) over base as n_base,
  volume::double / (avg(volume) over base) as vr from bars b left join idx using (trade_date) window l as (partition by ticker order by trade_date), base as (partition by ticker order by trade_date rows between 20 preceding and 1 preceding)),
v as (select *, stddev_samp(lr) over (partition by ticker order by trade_date rows between 19 preceding and 1 preceding) * sqrt(252) as vol, case when prior = 0 then 0.0 else close / prior - 1 end as ret, case when ip = 0 then 0.0 else index_close / ip - 1 end as ir from j)
select ticker, trade_date, n_base, case when n_base >= 10 then round(ret, 6) end as window_return, case when n_base >= 10 then round(vr, 6) end as volume_ratio, case when n_base >= 10 then round(vol, 6) end as volatility, case when n_base >= 10 then round(ret - coalesce(ir, 0), 6) end as abnormal_return from v""")
def market_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    index = b.groupBy("trade_date").agg((F.sum(F.col("close").cast("decimal(18,2)")).cast("double") / F.count("*")).alias("index_close"))
    w = market.windows(b, index)
    return w.select("ticker", "trade_date", "n_base", *[F.round(c, 6).alias(c) for c in ("window_return", "volume_ratio", "volatility", "abnormal_return")])


SESSIONS_SQL = """g as (select *, case when lag(ts) over w is null or epoch_us(ts) - epoch_us(lag(ts) over w) > 72::bigint * 3600000000 then 1 else 0 end as new from events window w as (partition by user_id, event_type order by ts, event_id)),
c as (select *, sum(new) over (partition by user_id, event_type order by ts, event_id rows unbounded preceding) as cluster from g),
s as (select *, 1.0::double / row_number() over (partition by user_id, event_type, cluster order by ts, event_id) as novelty from c)"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.sessions(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id", hours=72)


@query(f"with {SESSIONS_SQL} select event_id, user_id, event_type, cluster::bigint as cluster, novelty from s")
def session_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(spark, sf_dir).select("event_id", "user_id", "event_type", F.col("cluster").cast("long").alias("cluster"), "novelty")


@query(f"with {SESSIONS_SQL}, z as (select user_id, event_type, cluster, count(*) n from s group by all) select event_type, count(*) clusters, count(*) filter (n = 1) singletons, count(*) filter (n > 1) multi, max(n) largest, 1 - count(*)::double / sum(n)::double as compression from z group by event_type")
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = sessions(spark, sf_dir).groupBy("user_id", "event_type", "cluster").agg(F.count("*").alias("n"))
    return z.groupBy("event_type").agg(F.count("*").alias("clusters"), F.count(F.when(F.col("n") == 1, 1)).alias("singletons"), F.count(F.when(F.col("n") > 1, 1)).alias("multi"), F.max("n").alias("largest"), (1 - F.count("*").cast("double") / F.sum("n").cast("double")).alias("compression"))


@query(f"with {SESSIONS_SQL} select user_id, event_type, cluster::bigint as cluster, count(*) observation_count, max(value) impact_score, sum(cast(value as decimal(18,4)))::double sentiment_sum, arg_max(event_id, (value, -event_id)) representative_id, min(ts) first_ts, max(ts) last_ts, min(novelty) novelty from s group by all")
def canonical_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clustering.canonical(sessions(spark, sf_dir), ["user_id", "event_type"], "value", "value", "ts", "event_id")
    return out.withColumn("cluster", F.col("cluster").cast("long"))


@query("select event_type, window_start, count(*) n from (select event_type, time_bucket(interval '6 hours', ts) as window_start from events) group by all")
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return w.select("event_type", F.col("w.start").alias("window_start"), "n")


@query()
def semantic_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered assignment of the embeddings, one entity a label, an hour between rows."""
    e = table(spark, sf_dir, "embeddings")
    rows = e.select(F.col("label").cast("string").alias("entity"), F.col("vec_id").cast("long").alias("seq"), F.timestamp_seconds(F.col("vec_id") * 3600).alias("ts"), F.lit("Macroeconomic").alias("event_type"), F.col("embedding").alias("vector"))
    return clustering.assign(rows)


@query("""with n as (select vec_id, label, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as norm from embeddings),
p as (select a.vec_id, b.vec_id as near_id, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::double * z[2]::double)) / (a.norm * b.norm) as cosine from n a join n b on a.label = b.label and a.vec_id <> b.vec_id and abs(a.vec_id - b.vec_id) <= 72)
select vec_id, near_id, round(cosine, 6) as cosine, cosine >= 0.85 as similar from (select *, row_number() over (partition by vec_id order by cosine desc, near_id) k from p) where k = 1""")
def nearest_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar other vector of the same label within 72 hours, an hour between rows."""
    e = table(spark, sf_dir, "embeddings")
    rows = e.select(F.col("vec_id").alias("id"), F.col("label").alias("entity"), F.timestamp_seconds(F.col("vec_id") * 3600).alias("ts"), F.col("embedding").alias("vector"))
    near = clustering.nearest(rows)
    return near.select(F.col("id").alias("vec_id"), "near_id", F.round("cosine", 6).alias("cosine"), (F.col("cosine") >= 0.85).alias("similar"))


def _circle(angles: pd.Series) -> pd.Series:
    return pd.Series([[math.cos(a), math.sin(a)] if math.isfinite(a) else [math.nan, math.nan] for a in angles])


_FITS = ", ".join(f"('{a}', '{b}')" for a, many in COMPATIBLE.items() for b in many)


@query(f"""with recursive ev as (select user_id, event_id, ts, {_CASE(0)} kind, cos(value * pi() / 50) x, sin(value * pi() / 50) y, row_number() over (partition by user_id order by ts, event_id) k from events),
r(user_id, k, cl, cluster_id, novelty) as (
  select distinct user_id, 0::bigint, []::struct(name bigint, sx double, sy double, n bigint, kind varchar, latest timestamp)[], null::bigint, null::double from events
  union all
  select user_id, k, case when b is null then list_append(cl, {{name: event_id, sx: x, sy: y, n: 1::bigint, kind: kind, latest: ts}}) else list_transform(cl, lambda c: case when c.name = b.name then {{name: c.name, sx: c.sx + x, sy: c.sy + y, n: c.n + 1, kind: c.kind, latest: greatest(c.latest, ts)}} else c end) end,
    case when b is null then event_id else b.name end, case when b is null then 1.0::double else 1.0::double / (b.n + 1) end
  from (select *, fit[list_position(score, list_max(score))] b from (select *, list_transform(fit, lambda c: (c.sx * x + c.sy * y) / sqrt(c.sx * c.sx + c.sy * c.sy)) score from (
    select ev.*, r.cl, list_filter(r.cl, lambda c: ev.ts - c.latest <= interval 72 hour and (c.kind = ev.kind or (c.kind, ev.kind) in ({_FITS}) or (ev.kind, c.kind) in ({_FITS})) and (c.sx * ev.x + c.sy * ev.y) / sqrt(c.sx * c.sx + c.sy * c.sy) >= 0.85::double) fit
    from r join ev on ev.user_id = r.user_id and ev.k = r.k + 1))))
select ev.event_id, r.cluster_id, r.novelty from r join ev using (user_id, k)""")
def ordered_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of an entity by time, each in the most similar open cluster: two values are similar where their angles on a
    circle of 100 are near, so clusters form.

    A value may lie in the middle between two clusters, and then the last digits of the sines decide: they are taken from
    the C library, as SQL takes them; those of Java differ at times."""
    e = table(spark, sf_dir, "events")
    kind = F.create_map(*[F.lit(x) for a, b in TYPES.items() for x in (a, b[0])])[F.col("event_type")]
    turn = F.pandas_udf(_circle, "array<double>")(F.col("value") * math.pi / 50)
    rows = e.select(F.col("user_id").cast("string").alias("entity"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("event_type"), turn.alias("vector"))
    return clustering.assign(rows, unit=True).select(F.col("seq").alias("event_id"), "cluster_id", "novelty")
