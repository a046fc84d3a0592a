"""Portfolio queries: exposures are orders with their customer, nation and region."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.lexicon import SHOCKS
from tidemark.operators import portfolio as P
from tidemark.operators import readmodels as M

from .registry import query
from .tables import table

#: (event, type, entity, impact): the entity is an obligor; one impact is out of range, one type unknown.
SIGNALS = [
    ("E1", "Credit Event", "Customer#000000007", 10.0),
    ("E2", " geopolitical", "customer#000000011", 8.0),
    ("E3", "Commodity / Supply Chain", " Customer#000000014 ", 9.2),
    ("E4", "Market / Liquidity", "Global", 10.0),
    ("E5", "NO_EVENT", "Customer#000000007", 5.0),
    ("E6", "Credit Event", "Nobody", 10.0),
    ("E7", "Rumour", "Customer#000000020", 5.5),
    ("E8", "Macroeconomic", "Global", 99.0),
]
PAIRS = [("E1", "E3"), ("E3", "E4"), ("E2", "E1"), ("E5", "E4")]

_RULES = ", ".join(f"('{a}', '{b}', '{c}', {d}, {e}, {f}, {g})" for a, b, c, d, e, f, g in SHOCKS)
_KNOWN = ", ".join(f"'{r[1].lower()}'" for r in SHOCKS)
EXPOSURES_SQL = """exposures as (
  select o_orderkey as exposure_id, c_name as obligor, c_mktsegment as sector, r_name as geography,
    case left(o_orderpriority, 1) when '1' then 'Corporate Bond' when '2' then 'Equity' when '3' then 'Revolving Credit Facility' else 'Corporate Loan' end as asset_type,
    cast(cast(o_totalprice as decimal(18,2)) as decimal(20,2)) as ead,
    cast(case o_orderstatus when 'F' then 0.02 when 'O' then 0.005 else 0.0005 end as decimal(9,6)) as pd,
    cast(case o_orderstatus when 'F' then 0.55 when 'O' then 0.45 else 0.35 end as decimal(9,6)) as lgd
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""
SHOCKS_SQL = f"""signals(event_id, event_type, entity, impact) as (values {", ".join(f"('{a}', '{b}', '{c}', {d}::double)" for a, b, c, d in SIGNALS)}),
rules(rule_id, rule_type, scope, pd, lgd, bond, equity) as (values {_RULES}),
shocks as (
  select event_id, event_type, entity, impact, case when impact < 1 or impact > 10 then 'impact out of range' end as error, rule_id, scope, round((impact - 1) / 9, 6) as severity,
    cast(round(greatest(0.0, least(1.0, pd::double * round((impact - 1) / 9, 6))), 6) as decimal(9,6)) as pd_delta, cast(round(greatest(0.0, least(1.0, lgd::double * round((impact - 1) / 9, 6))), 6) as decimal(9,6)) as lgd_delta,
    cast(round(greatest(-1.0, least(1.0, bond::double * round((impact - 1) / 9, 6))), 6) as decimal(9,6)) as bond_shock, cast(round(greatest(-1.0, least(1.0, equity::double * round((impact - 1) / 9, 6))), 6) as decimal(9,6)) as equity_shock
  from signals join rules on lower(rule_type) = case when lower(trim(event_type)) in ({_KNOWN}) then lower(trim(event_type)) else 'other / unclear' end)"""
STRESS_SQL = f"""with {EXPOSURES_SQL}, {SHOCKS_SQL},
home as (select event_id, arg_min(sector, exposure_id) as sector, arg_min(geography, exposure_id) as geography from shocks join exposures on lower(trim(entity)) = lower(trim(obligor)) group by event_id),
stressed as (
  select s.event_id, e.*, rule_id, e.ead * e.pd * e.lgd as base_el,
    case when asset_type <> 'Equity' then least(1.0::decimal(9,6), (e.pd + pd_delta)::decimal(9,6)) else e.pd end as stressed_pd,
    case when asset_type <> 'Equity' then least(1.0::decimal(9,6), (e.lgd + lgd_delta)::decimal(9,6)) else e.lgd end as stressed_lgd,
    e.ead * case asset_type when 'Corporate Bond' then bond_shock when 'Equity' then equity_shock else 0::decimal(9,6) end as mtm_impact
  from shocks s left join home h on s.event_id = h.event_id join exposures e on s.error is null and (
    s.scope = 'ENTITY' and lower(trim(s.entity)) = lower(trim(e.obligor)) or s.scope = 'SECTOR' and e.sector = h.sector or s.scope = 'GEOGRAPHY' and e.geography = h.geography or s.scope = 'BROAD_MARKET')),
stress as (select *, ead * stressed_pd * stressed_lgd - base_el as incremental_el from stressed),
dims as (
  select event_id, case when grouping(sector) = 0 then 'sector' when grouping(geography) = 0 then 'geography' else 'asset_type' end as dimension, coalesce(sector, geography, asset_type) as name,
    count(*) as n, sum(ead) as ead, sum(incremental_el) as incremental_el, sum(mtm_impact) as mtm_impact
  from stress group by grouping sets ((event_id, sector), (event_id, geography), (event_id, asset_type))),
totals as (
  select s.event_id, s.scope, s.error, count(t.exposure_id) as n_affected, coalesce(sum(t.ead), 0) as affected_ead, coalesce(sum(incremental_el), 0) as incremental_el, coalesce(sum(mtm_impact), 0) as mtm_impact
  from shocks s left join stress t on s.event_id = t.event_id group by all)"""


def exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    by_status = lambda f, op, rest: F.when(F.col("o_orderstatus") == "F", f).when(F.col("o_orderstatus") == "O", op).otherwise(rest).cast(P.RATE)
    kind = F.substring("o_orderpriority", 1, 1)
    asset = F.when(kind == "1", "Corporate Bond").when(kind == "2", "Equity").when(kind == "3", "Revolving Credit Facility").otherwise("Corporate Loan")
    place = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.select(
        F.col("o_orderkey").alias("exposure_id"), F.col("c_name").alias("obligor"), F.lit(None).cast("string").alias("ticker"), F.array().cast("array<string>").alias("aliases"),
        F.col("c_mktsegment").alias("sector"), F.col("r_name").alias("geography"), asset.alias("asset_type"), F.col("o_totalprice").cast("decimal(18,2)").alias("ead"),
        by_status(0.02, 0.005, 0.0005).alias("pd"), by_status(0.55, 0.45, 0.35).alias("lgd"),
    )


def shocks(spark: SparkSession) -> DataFrame:
    return P.shock_map(spark.createDataFrame(SIGNALS, "event_id string, event_type string, entity string, impact double"))


def stressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.stress(shocks(spark), exposures(spark, sf_dir))


def _dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = exposures(spark, sf_dir).agg(F.sum("ead").cast("double").alias("total_ead"))
    return P.by_dimension(stressed(spark, sf_dir), total)


def _doubles(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes])


@query("select event_id, event_type, entity, impact, error, rule_id, scope, severity, pd_delta::double pd_delta, lgd_delta::double lgd_delta, bond_shock::double bond_shock, equity_shock::double equity_shock from shocks".join([f"with {SHOCKS_SQL} ", ""]))
def shock_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubles(shocks(spark))


@query(STRESS_SQL + " select event_id, exposure_id, asset_type, ead::double ead, stressed_pd::double stressed_pd, stressed_lgd::double stressed_lgd, base_el::double base_el, incremental_el::double incremental_el, mtm_impact::double mtm_impact from stress")
def stress_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubles(stressed(spark, sf_dir).select("event_id", "exposure_id", "asset_type", "ead", "stressed_pd", "stressed_lgd", "base_el", "incremental_el", "mtm_impact"))


@query(STRESS_SQL + " select event_id, scope, error, n_affected, affected_ead::double affected_ead, incremental_el::double incremental_el, mtm_impact::double mtm_impact from totals")
def stress_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubles(P.totals(shocks(spark), stressed(spark, sf_dir)))


@query(STRESS_SQL + " select event_id, dimension, name, n, ead::double ead, incremental_el::double incremental_el, mtm_impact::double mtm_impact, ead::double / (select sum(ead)::double from exposures) * 100 as pct_of_portfolio from dims")
def stress_by_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubles(_dims(spark, sf_dir))


@query(STRESS_SQL + " select event_id, dimension, name, ead::double ead, incremental_el::double incremental_el, mtm_impact::double mtm_impact, incremental_el::double * 100 / nullif(sum(incremental_el) over w, 0)::double as el_pct, mtm_impact::double * 100 / nullif(sum(mtm_impact) over w, 0)::double as mtm_pct from dims window w as (partition by event_id, dimension)")
def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubles(P.attribution(_dims(spark, sf_dir)))


_MEASURES = " union all ".join(f"select event_id, exposure_id, '{m}' as measure, {c}::double as size from stress" for m, c in (("ead", "ead"), ("incremental_el", "incremental_el"), ("mtm_impact", "abs(mtm_impact)")))


@query(STRESS_SQL + f", m as ({_MEASURES}), k as (select *, row_number() over (partition by event_id, measure order by size desc, exposure_id) place from m) select event_id, exposure_id, measure, size, place from k where place <= 5")
def top_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.top_by(stressed(spark, sf_dir))


_PAIRS = ", ".join(f"({k}, '{a}', '{b}')" for k, (a, b) in enumerate(PAIRS))


@query(STRESS_SQL + f" select place, event_a, event_b, (b.affected_ead - a.affected_ead)::double delta_ead, (b.incremental_el - a.incremental_el)::double delta_el, (abs(b.mtm_impact) - abs(a.mtm_impact))::double delta_mtm from (values {_PAIRS}) p(place, event_a, event_b) join totals a on a.event_id = event_a join totals b on b.event_id = event_b")
def scenario_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = P.totals(shocks(spark), stressed(spark, sf_dir))
    return _doubles(P.compare(total, spark.createDataFrame([(k, *p) for k, p in enumerate(PAIRS)], "place int, event_a string, event_b string")))


@query(STRESS_SQL + ", a as (select * from dims where event_id = 'E1'), b as (select * from dims where event_id = 'E3') select dimension, name, (coalesce(b.incremental_el, 0) - coalesce(a.incremental_el, 0))::double delta_el, (abs(coalesce(b.mtm_impact, 0)) - abs(coalesce(a.mtm_impact, 0)))::double delta_mtm from a full join b using (dimension, name)")
def attribution_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubles(P.attribution_diff(_dims(spark, sf_dir), "E1", "E3"))


@query(f"with {EXPOSURES_SQL} select case when grouping(sector) = 0 then 'sector' when grouping(geography) = 0 then 'geography' when grouping(asset_type) = 0 then 'asset_type' else 'total' end as dimension, coalesce(sector, geography, asset_type, 'all') as name, count(*) n, sum(ead)::double ead, sum(ead * pd * lgd)::double base_el, case when grouping(sector) = 0 then sum(ead)::double > 0.3 * (select sum(ead)::double from exposures) else false end as flagged from exposures group by grouping sets ((sector), (geography), (asset_type), ())")
def portfolio_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = exposures(spark, sf_dir)
    dims = P.DIMENSIONS
    g = e.groupingSets([[F.col(d)] for d in dims] + [[]], *dims).agg(F.count("*").alias("n"), F.sum("ead").cast("double").alias("ead"), F.sum(F.col("ead") * F.col("pd") * F.col("lgd")).cast("double").alias("base_el"), F.grouping_id(*dims).alias("g"))
    total = F.max("ead").over(Window.partitionBy())  # some dozen rows
    name = F.when(F.col("g") == 3, "sector").when(F.col("g") == 5, "geography").when(F.col("g") == 6, "asset_type").otherwise("total")
    return g.select(name.alias("dimension"), F.coalesce(*dims, F.lit("all")).alias("name"), "n", "ead", "base_el", ((F.col("g") == 3) & (F.col("ead") > 0.3 * total)).alias("flagged"))


@query(f"with {EXPOSURES_SQL}, o as (select obligor, count(*) n, sum(ead) ead from exposures group by obligor) select obligor, n, ead::double ead, ead::double / (select sum(ead) from o)::double share, ead::double > 0.15 * (select sum(ead) from o)::double flagged from o order by o.ead desc, obligor limit 10")
def top_obligors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = exposures(spark, sf_dir)
    total = e.agg(F.sum("ead").cast("double").alias("total"))
    o = e.groupBy("obligor").agg(F.count("*").alias("n"), F.sum("ead").alias("ead")).orderBy(F.desc("ead"), "obligor").limit(10)
    o = o.join(F.broadcast(total))  # one row
    return o.select("obligor", "n", F.col("ead").cast("double").alias("ead"), (F.col("ead").cast("double") / F.col("total")).alias("share"), (F.col("ead").cast("double") > 0.15 * F.col("total")).alias("flagged"))


@query(f"with {EXPOSURES_SQL}, o as (select sector, obligor, sum(ead) ead from exposures group by all), r as (select *, row_number() over (partition by sector order by ead desc, obligor) k from o) select sector, sum(ead)::double ead, count(*) obligors, sum(case when k <= 5 then ead else 0 end)::double / sum(ead)::double as top5_share from r group by sector")
def portfolio_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each sector's five largest obligors: the five of each task first, which is what a ranked filter shuffles."""
    o = exposures(spark, sf_dir).groupBy("sector", "obligor").agg(F.sum("ead").alias("ead"))
    k = F.row_number().over(Window.partitionBy("sector").orderBy(F.desc("ead"), "obligor"))
    top = o.withColumn("k", k).filter("k <= 5").groupBy("sector").agg(F.sum("ead").alias("top"))
    return o.groupBy("sector").agg(F.sum("ead").alias("ead"), F.count("*").alias("obligors")).join(top, "sector").select("sector", F.col("ead").cast("double").alias("ead"), "obligors", (F.col("top").cast("double") / F.col("ead").cast("double")).alias("top5_share"))



# ---- read models: one JSON payload a subject ----
_C = lambda x: f"round(({x}) * 100)::bigint"
_PCT = lambda a, b: f"coalesce(round(({a})::double * 100 / nullif(({b})::double, 0), 4), 0.0)"
_SLICES = " union all ".join(f"select '{d}' d, {d} as name, count(*) n, sum(ead) ead from exposures group by {d}" for d in P.DIMENSIONS)
_ONE_SLICE = lambda d: f"(select list({{'name': name, 'n': n, 'ead': {_C('ead')}, 'pct': {_PCT('ead', 'w')}}} order by ead desc, name) from sl, whole where d = '{d}')"


@query(f"""with {EXPOSURES_SQL}, whole as (select sum(ead) w from exposures), sl as ({_SLICES}), ob as (select obligor, sum(ead) ead from exposures group by obligor),
top as (select * from ob order by ead desc, obligor limit 5), fl as (select 'sector ' || name f from sl, whole where d = 'sector' and ead::double > 0.3 * w::double union all select 'obligor ' || obligor from ob, whole where ead::double > 0.15 * w::double)
select to_json({{'total_ead': {_C('(select w from whole)')}, 'base_el': {_C('(select sum(ead * pd * lgd) from exposures)')}, 'exposure_count': (select count(*) from exposures), 'obligor_count': (select count(*) from ob),
 {", ".join(f"'{d}_distribution': {_ONE_SLICE(d)}" for d in P.DIMENSIONS)}, 'top_obligors': (select list({{'obligor': obligor, 'ead': {_C('ead')}, 'pct': {_PCT('ead', 'w')}}} order by ead desc, obligor) from top, whole), 'flags': coalesce((select list(f order by f) from fl), [])}})::varchar as payload""")
def portfolio_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = M.portfolio_overview(exposures(spark, sf_dir))
    return one.select(M.payload(one).alias("payload"))


_OVERVIEW_SQL = f"""whole as (select sum(ead) w from exposures), ag as (select event_id, count(*) n, sum(ead) ead, sum(base_el) base, sum(base_el + incremental_el) stress, sum(mtm_impact) mtm from stress group by event_id),
rk as (select *, row_number() over (partition by event_id order by ead desc, exposure_id) place from stress),
tp as (select event_id, list({{'exposure_id': exposure_id, 'obligor': obligor, 'ead': {_C('ead')}, 'incremental_el': {_C('incremental_el')}, 'mtm_impact': {_C('mtm_impact')}}} order by place) top from rk where place <= 5 group by event_id),
ov as (select s.event_id, entity, scope as shock_scope, case when error is not null then 'ERROR' when upper(trim(event_type)) = 'NO_EVENT' then 'NO_EVENT' when n is null then 'NO_EXPOSURE' else 'STRESSED' end as status, coalesce(n, 0) n_affected, {_C('coalesce(ead, 0)')} affected_ead,
  {_PCT('coalesce(ead, 0)', 'w')} affected_ead_pct, {_C('coalesce(base, 0)')} base_el, {_C('coalesce(stress, 0)')} stressed_el, {_C('coalesce(stress, 0) - coalesce(base, 0)')} incremental_el, {_PCT('coalesce(stress, 0) - coalesce(base, 0)', 'coalesce(base, 0)')} incremental_el_pct, {_C('coalesce(mtm, 0)')} mtm_impact, coalesce(top, []) top
  from shocks s left join ag using (event_id) left join tp using (event_id), whole)"""
_OV_FIELDS = ["event_id", "entity", "shock_scope", "status", "n_affected", "affected_ead", "affected_ead_pct", "base_el", "stressed_el", "incremental_el", "incremental_el_pct", "mtm_impact"]
_OV = lambda t: ", ".join(f"'{c}': {t}.{c}" for c in _OV_FIELDS) + f", 'stress_applied': {t}.status = 'STRESSED'"


def _overviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.event_overviews(shocks(spark), stressed(spark, sf_dir), exposures(spark, sf_dir))


@query(STRESS_SQL + f", {_OVERVIEW_SQL} select event_id, to_json({{{_OV('ov')}, 'top_exposures': top}})::varchar payload from ov")
def event_overviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _overviews(spark, sf_dir)
    return rows.select("event_id", M.payload(rows).alias("payload"))


@query(STRESS_SQL + f""", {_OVERVIEW_SQL}, pr(place, event_a, event_b) as (values {_PAIRS}),
df as (select place, dimension, name, sum(g * incremental_el) el, sum(g * abs(mtm_impact)) mtm from (select place, event_a as event_id, -1 g from pr union all select place, event_b, 1 from pr) join dims using (event_id) group by all),
ls as (select place, list({{'dimension': dimension, 'name': name, 'incremental_el_difference': {_C('el')}, 'absolute_mtm_difference': {_C('mtm')}}} order by dimension, name) l from df group by place)
select place, to_json({{'scenario_a': {{{_OV('a')}}}, 'scenario_b': {{{_OV('b')}}}, 'deltas': {{'affected_ead_difference': b.affected_ead - a.affected_ead, 'incremental_el_difference': b.incremental_el - a.incremental_el, 'absolute_mtm_difference': abs(b.mtm_impact) - abs(a.mtm_impact)}},
 'attribution_differences': coalesce(l, [])}})::varchar payload from pr join ov a on a.event_id = event_a join ov b on b.event_id = event_b left join ls using (place)""")
def scenario_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spark.createDataFrame([(k, *p) for k, p in enumerate(PAIRS)], "place int, event_a string, event_b string")
    out = M.scenario_comparisons(_overviews(spark, sf_dir), _dims(spark, sf_dir), pairs)
    return out.select("place", M.payload(out, ["scenario_a", "scenario_b", "deltas", "attribution_differences"]).alias("payload"))
