"""Registered queries: rank correlations with their p, horizons, profiles, vector search, signals of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import evaluate, ingest, vectors
from tidemark.operators.profile import QUANTILES, profile

from .registry import query
from .tables import table

#: Simpson's rule over the tail of Student's t, an independent way to the same p.
_P = """case when n >= 5 and abs({r}) < 1 then least(1, 2 * (pi() / 2 - atan(abs({r}) / sqrt(1 - {r} * {r}))) / 4000 / 3 * list_sum(list_transform(range(0, 4001), lambda k: case when k in (0, 4000) then 1 when k % 2 = 1 then 4 else 2 end
  * pow(greatest(cos(atan(abs({r}) / sqrt(1 - {r} * {r})) + k * (pi() / 2 - atan(abs({r}) / sqrt(1 - {r} * {r}))) / 4000), 0), n - 3))) * exp(lgamma((n - 1) / 2.0::double) - lgamma((n - 2) / 2.0::double)) / sqrt(pi())) end"""
_RANK = lambda c, g: f"rank() over (partition by {g} order by {c}) + (count(*) over (partition by {g}, {c}) - 1) / 2.0::double"


@query(f"""with t as (select o_orderpriority grp, o_custkey p, o_totalprice - 250000 s, abs(o_totalprice - 250000) a from orders),
r as (select grp, {_RANK('p', 'grp')} rp, {_RANK('s', 'grp')} rs, {_RANK('a', 'grp')} ra from t), c as (select grp, count(*) n, corr(rp, rs) rs, corr(rp, ra) ra from r group by grp)
select grp, n, round(rs, 6) rho_signed, round({_P.format(r='rs')}, 6) p_signed, round(ra, 6) rho_abs, round({_P.format(r='ra')}, 6) p_abs from c""")
def rank_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlations of a predictor with a signed target and with its size, and their p."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("grp"), F.col("o_custkey").alias("p"), (F.col("o_totalprice") - 250000).alias("target"))
    r = evaluate.rank_correlations(o, ["grp"], "p", "target")
    return r.select("grp", "n", *[F.round(c, 6).alias(c) for c in ("rho_signed", "p_signed", "rho_abs", "p_abs")])


_HORIZONS = {"d1": "l_discount - 0.05::double", "d7": "case when l_linenumber > 1 then l_tax - 0.04::double end"}


@query("with h as (" + " union all ".join(f"select l_returnflag tier, '{k}' horizon, {v} x from lineitem" for k, v in _HORIZONS.items()) + """)
select tier, horizon, count(*) as n_rows, count(x) n, round(avg(x), 6) mean, round(median(x), 6) median, round(avg(abs(x)), 6) abs_mean, round(median(abs(x)), 6) abs_median from h group by all""")
def tier_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed and absolute means and medians of each tier over several horizons; a horizon may be missing."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("tier"), (F.col("l_discount") - 0.05).alias("d1"), F.when(F.col("l_linenumber") > 1, F.col("l_tax") - 0.04).alias("d7"))
    s = evaluate.horizon_stats(rows, ["tier"], ["d1", "d7"]).withColumnRenamed("rows", "n_rows")
    return s.select("tier", "horizon", "n_rows", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "abs_mean", "abs_median")])


def _profile_sql(name: str, numbers: list[str], others: list[str]) -> str:
    edge = lambda x: f"(case when {x} < 0 then -1 else 1 end * (left(abs({x})::varchar, 3) || repeat('0', greatest(length(abs({x})::varchar) - 3, 0)))::bigint) / 10000.0::double"
    rows = []
    for c in numbers:
        q = ", ".join(f"{edge(f'quantile_disc(x, {q})')} {k}" for k, q in QUANTILES.items())
        rows.append(f"select '{c}' col, count(*) n, count(*) - count(x) n_null, min(x) / 10000.0::double low, max(x) / 10000.0::double high, round(avg(x) / 10000, 6) mean, round(stddev_samp(x) / 10000, 6) std, {q} from (select round({c}::decimal(38,6) * 10000)::bigint x from {name})")
    none = ", ".join(f"null::double {c}" for c in ("low", "high", "mean", "std", *QUANTILES))
    rows += [f"select '{c}', count(*), count(*) - count({c}), {none} from {name}" for c in others]
    return " union all ".join(rows)


def _profiled(df: DataFrame) -> DataFrame:
    return profile(df).select(F.col("column").alias("col"), "n", "n_null", "low", "high", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), *QUANTILES)


@query(_profile_sql("orders", ["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderdate", "o_orderpriority"]))
def profile_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profiled(table(spark, sf_dir, "orders"))


@query(_profile_sql("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"], ["l_returnflag", "l_linestatus", "l_shipdate"]))
def profile_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profiled(table(spark, sf_dir, "lineitem"))


_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::double * z[2]::double))"


@query(f"""with s as (select a.vec_id as query, b.vec_id as id, {_DOT.format(a='a.embedding', b='b.embedding')} as score from embeddings a, embeddings b where a.vec_id % 20 = 0)
select query, id, round(score, 6) score, k::int as rank from (select *, row_number() over (partition by query order by score desc, id) k from s) where k <= 10""")
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all vectors for each whose id is divisible by 20."""
    e = table(spark, sf_dir, "embeddings")
    found = vectors.search(vectors.build(e, "vec_id", "embedding"), e.filter("vec_id % 20 = 0"), "vec_id", "embedding", 10)
    return found.select("query", "id", F.round("score", 6).alias("score"), "rank")


@query(f"""with d as (select label, vec_id // 10 b, g.i, avg(embedding[g.i]::double) x, max(vec_id) last from embeddings, range(1, 65) g(i) group by all),
m as (select label, b, list(x order by i) c, sqrt(sum(x * x)) n, max(last) last from d group by all), k as (select label::bigint * 1000000 + b as cluster, label, last, list_transform(c, lambda x: x / n) c from m),
s as (select e.vec_id id, e.label, k.cluster, k.label kl, k.last, {_DOT.format(a='k.c', b='e.embedding')} score from embeddings e, k where e.vec_id % 20 = 0),
t as (select * from (select *, row_number() over (partition by id order by score desc, cluster) r from s) where r <= 50 and label = kl and abs(id - last) <= 72)
select id, cluster, round(score, 6) score from (select *, row_number() over (partition by id order by score desc, r) w from t) where w = 1""")
def cluster_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best cluster of a candidate's entity and window among the 50 nearest of all clusters, ten hours of a label a cluster."""
    e = table(spark, sf_dir, "embeddings")
    hour = lambda c: F.timestamp_seconds(F.col(c) * 3600)
    b = F.expr("vec_id div 10")
    mean = F.array(*[F.avg(F.col("embedding")[k].cast("double")) for k in range(64)])
    c = e.groupBy("label", b.alias("b")).agg(mean.alias("c"), F.max("vec_id").alias("last"))
    norm = F.sqrt(vectors.dot(F.col("c"), F.col("c")))
    clusters = c.select((F.col("label").cast("long") * 1_000_000 + F.col("b")).alias("cluster"), F.col("label").cast("string").alias("entity"), F.lit("Macroeconomic").alias("event_type"), hour("last").alias("updated_at"), F.transform("c", lambda x: x / norm).alias("centroid"))
    asked = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("entity"), F.lit("Macroeconomic").alias("event_type"), hour("vec_id").alias("ts"), F.col("embedding").alias("vector"))
    return vectors.retrieve(clusters, asked, 50).select("id", "cluster", F.round("score", 6).alias("score"))


_HOST = "lower(regexp_extract(url, '^https?://([^/:?#]+)', 1))"


@query(f"""with p as (select page_id, {_HOST} host, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) as path from pages),
s as (select page_id, coalesce(host = 'example.com' or ends_with(host, '.example.com') or host = 'example.net' or ends_with(host, '.example.net'), false) d, len(list_filter(string_split(path, '/'), lambda t: starts_with(upper(trim(t)), 'FR') or starts_with(upper(trim(t)), 'EN'))) > 0 t from p)
select page_id, concat_ws(' + ', case when d then 'DOMAIN' end, case when t then 'THEME' end) reasons, d or t as kept from s""")
def page_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The funnel on pages: the host as the domain, the parts of the path as themes."""
    p = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "^https?://([^/:?#]+)", 1)
    themes = F.replace(F.regexp_extract("url", "^https?://[^/]+/([^?#]*)", 1), F.lit("/"), F.lit(";"))
    signals = {"DOMAIN": ingest.domain_signal(host, None, ["example.com", "example.net"]), "THEME": ingest.theme_signal(themes, ["FR", "EN"])}
    return ingest.candidate_filter(p, signals).select("page_id", F.array_join("reasons", " + ").alias("reasons"), "kept")
