"""Registered queries: the market around each event, scores on top of it, price windows, and a merged cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import lexicon as X
from tidemark.functions import scoring as S
from tidemark.operators import market
from tidemark.sources.keyed import merge_series

from .events import BARS_SQL, SCORED_SQL, bars, scored
from .registry import query
from .tables import table

SECTORS = ["Energy", " technology", "Unknown", "Health care", "CONS DISC"]
_FUNDS = ", ".join(f"('{a}', '{b}')" for a, b in X.SECTOR_FUNDS.items())
_SECTOR = f"[{', '.join(repr(s) for s in SECTORS)}][user_id % 5 + 1]"

CONTEXT_SQL = f"""{BARS_SQL}, f(sector, fund) as (values {_FUNDS}), fd as (select fund as key, cast(ts as date) trade_date, avg(value::decimal(18,2)) as close from events join f on f.sector = lower(trim({_SECTOR})) group by all),
ev as (select event_id, user_id as ticker, cast(ts as date) event_date, fund from events left join f on f.sector = lower(trim({_SECTOR})) where event_type = 'error'),
w as (select *, count(*) over base n_base, lag(close) over l prior, case when volume <> 0 then volume end::double / avg(volume) over base ratio, case when close > 0 and lag(close) over l > 0 then ln(close / lag(close) over l) end lr
  from bars window l as (partition by ticker order by trade_date), base as (partition by ticker order by trade_date rows between 20 preceding and 1 preceding)),
v as (select *, stddev_samp(lr) over (partition by ticker order by trade_date rows between 19 preceding and 1 preceding) * sqrt(252) vol, case when prior = 0 then 0.0::double else (close - prior) / prior end stock from w),
an as (select ev.*, v.trade_date, n_base, ratio, vol, stock, coalesce(n_base >= 10, false) ok from ev asof left join v on ev.ticker = v.ticker and ev.event_date >= v.trade_date),
ser as (select 'index' as key, trade_date, index_close as close from idx union all select * from fd), op as (select key, arg_min(close, trade_date) opening from ser group by key),
asks as (select event_id, 'index' as key, trade_date d from an where ok union all select event_id, fund, trade_date from an where ok and fund is not null),
e1 as (select a.*, s.trade_date ed, s.close ec from asks a asof left join ser s on a.key = s.key and a.d >= s.trade_date),
e2 as (select e1.*, s.trade_date pd, s.close pc from e1 asof left join ser s on e1.key = s.key and e1.d - 1 >= s.trade_date),
e3 as (select e2.*, case when pd is not null then pc else opening end base from e2 left join op using (key)),
r as (select event_id, max(case when key = 'index' then x end) ir, max(case when key <> 'index' then x end) sm from (select event_id, key, case when ed >= d then case when base = 0 then 0 else (ec - base) / base end end x from e3) group by event_id),
ctx as (select an.event_id, ticker, trade_date as anchor_date, case when trade_date is null then 'NO_BARS' when ok then 'OK' else 'SHORT_HISTORY' end status, case when ok then round(stock, 6) end stock_return, case when ok then round(ir, 6) end index_return,
  case when ok then round(stock - coalesce(round(ir, 6), 0), 6) end abnormal_return, case when ok then round(sm, 6) end sector_movement, case when ok then round(ratio, 4) end volume_ratio, case when ok then round(vol, 6) end volatility from an left join r using (event_id))"""


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    of = F.create_map(*[F.lit(x) for pair in X.SECTOR_FUNDS.items() for x in pair])
    fund = F.try_element_at(of, F.lower(F.trim(F.get(F.lit(SECTORS), (F.col("user_id") % 5).cast("int")))))
    mean = (F.sum("v").cast("double") / F.count("*")).alias("close")
    funds = e.select(fund.alias("key"), F.to_date("ts").alias("trade_date"), F.col("value").cast("decimal(18,2)").alias("v")).filter("key is not null").groupBy("key", "trade_date").agg(mean)
    b = bars(spark, sf_dir)
    index = b.groupBy("trade_date").agg((F.sum(F.col("close").cast("decimal(18,2)")).cast("double") / F.count("*")).alias("index_close"))
    asked = e.filter("event_type = 'error'").select("event_id", F.col("user_id").alias("ticker"), F.to_date("ts").alias("event_date"), fund.alias("fund"))
    return market.event_context(asked, b, index, funds)


@query(f"with {CONTEXT_SQL} select * from ctx")
def event_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns of stock, index and sector over each event's own window."""
    return _context(spark, sf_dir)


@query(f"""with {CONTEXT_SQL}, {SCORED_SQL}, mk as (select event_id, status, case when status = 'OK' then round(cast(cast(greatest(0.70::double, least(1.30::double, 1.0::double
   + case when abs(abnormal_return) > 0.015::double then least(0.15::double, (abs(abnormal_return) - 0.015::double) * 3.0::double) when abs(abnormal_return) < 0.005::double then -0.10::double else 0.0 end
   + case when volume_ratio > 1.5::double then least(0.10::double, (volume_ratio - 1.5::double) * 0.05::double) when volume_ratio < 1 then -0.05::double else 0.0 end + case when volatility > 2 then 0.05::double when volatility < 1 then -0.05::double else 0.0 end)) as varchar) as decimal(38,17)), 4)::double else 1.0::double end m from ctx),
im as (select event_id, case status when 'OK' then 'LIVE' else 'SKIP' end as mode, m, round(case materiality when 'NO_EVENT' then 1.0::double when 'NON_MATERIAL_FINANCIAL_CONTENT' then 1 + least(1.0::double, raw / mm * m / 1.2::double) else greatest(1.0::double, least(10.0::double, 1 + 9 * greatest(0.0::double, least(1.0::double, raw / mm * m / 1.2::double)))) end, 2) impact from mk join raws using (event_id))
select event_id, mode, m market_modifier, impact, case when impact >= 8.5 then 'Critical' when impact >= 7 then 'High' when impact >= 5 then 'Moderate' when impact >= 3 then 'Low' else 'Minimal' end tier from im""")
def context_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with the modifier of the market around the event; without context it is 1."""
    c = _context(spark, sf_dir)
    m = F.when(F.col("status") == "OK", S.market_modifier(F.col("abnormal_return"), F.col("volume_ratio"), F.col("volatility"))).otherwise(1.0)
    c = c.select("event_id", F.when(F.col("status") == "OK", "LIVE").otherwise("SKIP").alias("mode"), m.alias("m"))
    x = c.join(scored(spark, sf_dir), "event_id").withColumn("impact", S.impact(F.col("materiality"), F.col("raw") / F.col("market_modifier") * F.col("m")))
    return x.select("event_id", "mode", F.col("m").alias("market_modifier"), "impact", S.tier(F.col("impact")).alias("tier"))


@query("""with e as (select event_id, user_id, ts, case when timestamp '2024-02-20' > ts + interval 56 day - interval 1 microsecond then '1d' else '15m' end iv from events where event_type = 'error'),
p as (select user_id, '15m' iv, ts, value c, value * 1.01::double h, value * 0.99::double l from (select user_id, ts, arg_max(value, event_id) as value from events where event_type <> 'error' group by all)
  union all select user_id, '1d', cast(ts::date as timestamp), arg_max(value, ts), max(value * 1.01::double), min(value * 0.99::double) from (select user_id, ts, arg_max(value, event_id) as value from events where event_type <> 'error' group by all) group by user_id, ts::date),
j as (select e.event_id, e.iv, p.* exclude (user_id, iv) from e left join p on p.user_id = e.user_id and p.iv = e.iv and p.ts >= e.ts - case e.iv when '1d' then interval 5 day else interval 24 hour end and p.ts < e.ts + case e.iv when '1d' then interval 5 day else interval 24 hour end),
g as (select event_id, iv, count(c) n, arg_min(c, ts) f, arg_max(c, ts) la, max(h) h, min(l) l from j group by event_id, iv)
select event_id, case n when 0 then 'unavailable' else 'success' end status, iv as interval, n n_points, round(f, 6) first_price, round(la, 6) last_price, round(la - f, 6) abs_change, case when n > 0 then round(case when f = 0 then 0 else (la - f) / f * 100 end, 6) end change_pct, round(h, 6) high_price, round(l, 6) low_price, round(h - l, 6) max_range from g""")
def price_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices around each error: by points where it is recent, by days where it is old."""
    e = table(spark, sf_dir, "events")
    points = e.filter("event_type <> 'error'").groupBy(F.col("user_id").alias("key"), "ts").agg(F.max_by("value", "event_id").alias("close"))
    points = points.withColumn("high", F.col("close") * 1.01).withColumn("low", F.col("close") * 0.99)
    asked = e.filter("event_type = 'error'").select("event_id", F.col("user_id").alias("key"), F.col("ts").alias("at"), F.lit("2024-02-20").cast("timestamp").alias("as_of"))
    w = market.price_windows(asked, points)
    return w.select("event_id", "status", "interval", "n_points", *[F.round(c, 6).alias(c) for c in ("first_price", "last_price", "abs_change", "change_pct", "high_price", "low_price", "max_range")])


_PRICES = "select user_id as ticker, ts, arg_max(value, event_id) as price from events where {} group by all"


@query(f"""with o as ({_PRICES.format("event_type in ('view', 'click')")}), n as ({_PRICES.format("event_type <> 'view'")}), a as (select ticker, count(*) n_new from n anti join o using (ticker, ts) group by ticker)
select ticker, ts, case when n_new is null then coalesce(o.price, n.price) else coalesce(n.price, o.price) end price from o full join n using (ticker, ts) left join a using (ticker)""")
def merged_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of prices and newly fetched ones: the last of a time stays, and what has nothing new is left as it is."""
    e = table(spark, sf_dir, "events")
    prices = lambda rows: rows.groupBy(F.col("user_id").alias("ticker"), "ts").agg(F.max_by("value", "event_id").alias("price"))
    merged, _ = merge_series(prices(e.filter("event_type in ('view', 'click')")), prices(e.filter("event_type <> 'view'")), ["ticker", "ts"])
    return merged
