"""Evaluation queries over orders, lineitem and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import evaluate
from tidemark.sources.keyed import insert_or_ignore, upsert

from .registry import query
from .tables import table


@query("with r as (select o_orderpriority p, rank() over (partition by o_orderpriority order by o_totalprice) + (count(*) over (partition by o_orderpriority, o_totalprice) - 1) / 2.0::double as a, rank() over (partition by o_orderpriority order by o_custkey) + (count(*) over (partition by o_orderpriority, o_custkey) - 1) / 2.0::double as b from orders) select p as grp, count(*) n, round(corr(a, b), 6) as rho from r group by p")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return evaluate.spearman(o, ["o_orderpriority"], "o_totalprice", "o_custkey").select(F.col("o_orderpriority").alias("grp"), "n", F.round("rho", 6).alias("rho"))


@query("select round(corr(l_quantity, l_extendedprice), 6) quantity_price, round(corr(l_quantity, l_discount), 6) quantity_discount, round(corr(l_extendedprice, l_discount), 6) price_discount from lineitem")
def pearson_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lambda a, b: F.round(F.corr(a, b), 6)
    return table(spark, sf_dir, "lineitem").agg(c("l_quantity", "l_extendedprice").alias("quantity_price"), c("l_quantity", "l_discount").alias("quantity_discount"), c("l_extendedprice", "l_discount").alias("price_discount"))


@query("select o_orderpriority as tier, count(*) n, round(sum(o_totalprice::decimal(18,2))::double / count(*), 4) mean, median(o_totalprice) med, min(o_totalprice) low, max(o_totalprice) high, round(stddev_samp(o_totalprice), 4) std from orders group by 1")
def tier_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "tier")
    med = evaluate.quantiles(o, ["tier"], "o_totalprice", {"med": 0.5})
    g = o.groupBy("tier").agg(F.count("*").alias("n"), F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / F.count("*"), 4).alias("mean"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), F.round(F.stddev_samp("o_totalprice"), 4).alias("std"))
    return g.join(med, "tier")


@query("select l_returnflag as flag, round(quantile_cont(l_extendedprice, 0.25), 6) p25, round(quantile_cont(l_extendedprice, 0.5), 6) p50, round(quantile_cont(l_extendedprice, 0.75), 6) p75, round(quantile_cont(l_extendedprice, 0.95), 6) p95, round(quantile_cont(l_extendedprice, 0.99), 6) p99 from lineitem group by 1")
def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "flag")
    shares = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
    return evaluate.quantiles(rows, ["flag"], "l_extendedprice", shares).select("flag", *[F.round(n, 6).alias(n) for n in shares])


@query("with e as (select list_distinct([quantile_cont(o_totalprice, x / 5.0) for x in range(0, 6)]) as q from orders), b as (select o_totalprice, len(list_filter(list_sort(q)[2:-2], lambda x: x < o_totalprice)) as bucket from orders, e) select bucket::bigint as bucket, count(*) n, min(o_totalprice) low, max(o_totalprice) high from b group by 1".replace("[quantile_cont(o_totalprice, x / 5.0) for x in range(0, 6)]", "quantile_cont(o_totalprice, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])"))
def quantile_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_totalprice")
    return evaluate.quantile_buckets(o, "o_totalprice", 5).groupBy(F.col("bucket").cast("long").alias("bucket")).agg(F.count("*").alias("n"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))


@query("select case when o_totalprice <= 100000 then 'a' when o_totalprice <= 200000 then 'b' when o_totalprice <= 400000 then 'c' else 'd' end as bin, count(*) n from orders group by 1")
def fixed_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right-closed bins."""
    x = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").groupBy(F.when(x <= 100000, "a").when(x <= 200000, "b").when(x <= 400000, "c").otherwise("d").alias("bin")).agg(F.count("*").alias("n"))


@query("select o_orderpriority as priority, count(*) filter (o_orderstatus = 'F') f, count(*) filter (o_orderstatus = 'O') o, count(*) filter (o_orderstatus = 'P') p from orders group by 1")
def pivot_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority")).pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    return g.select("priority", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


@query("select event_type, event_id, value from (select *, row_number() over (partition by event_type order by value desc, event_id) k from events) where k <= 10")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id"))
    return table(spark, sf_dir, "events").withColumn("k", k).filter("k <= 10").select("event_type", "event_id", "value")


@query("select user_id, d, event_id, value from (select *, cast(ts as date) d, row_number() over (partition by user_id, cast(ts as date) order by value desc, event_id) k from events) where k = 1")
def best_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "events").withColumn("d", F.to_date("ts")).groupBy("user_id", "d")
    return g.agg(F.max_by(F.struct("event_id", "value"), F.struct(F.col("value"), -F.col("event_id"))).alias("b")).select("user_id", "d", "b.event_id", "b.value")


@query("select event_id, value from events order by value desc, event_id limit 25")
def top25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").orderBy(F.desc("value"), "event_id").limit(25).select("event_id", "value")


@query("select c_mktsegment as segment, count(distinct c_custkey) n, count(distinct o_custkey) usable, count(distinct o_custkey) * 100.0::double / count(distinct c_custkey) as pct from customer left join orders on c_custkey = o_custkey group by 1")
def group_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("u", F.lit(1))
    g = table(spark, sf_dir, "customer").join(seen, "c_custkey", "left").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.count("u").alias("usable"))
    return g.withColumn("pct", F.col("usable") * 100.0 / F.col("n"))


@query("with n as (select l_orderkey as k, case when bool_or(l_returnflag = 'R') then 'R' else 'L' end as s from lineitem group by 1) select coalesce(k, o_orderkey) as o_orderkey, coalesce(s, o_orderstatus) as o_orderstatus from orders full join n on k = o_orderkey")
def upsert_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders, and the state that their lines give them: R with a returned line, L without."""
    state = F.when(F.bool_or(F.col("l_returnflag") == "R"), "R").otherwise("L")
    new = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(state.alias("o_orderstatus"))
    return upsert(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), new, ["o_orderkey"])


@query("select o_custkey as c_custkey, count(*) as n from orders group by 1 union all select c_custkey, 0 from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def new_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of orders stay; of all customers those join that are not there yet."""
    old = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return insert_or_ignore(old, table(spark, sf_dir, "customer").select("c_custkey", F.lit(0).cast("long").alias("n")), ["c_custkey"])


@query("select case when o_orderdate <= timestamp '1996-01-01' then 'train' when o_orderdate <= timestamp '1998-01-01' then 'validation' else 'test' end as split, count(*) n, min(o_orderdate) first_date, max(o_orderdate) last_date from orders group by 1")
def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    s = F.when(d <= F.lit("1996-01-01").cast("timestamp_ntz"), "train").when(d <= F.lit("1998-01-01").cast("timestamp_ntz"), "validation").otherwise("test")
    return table(spark, sf_dir, "orders").groupBy(s.alias("split")).agg(F.count("*").alias("n"), F.min(d).alias("first_date"), F.max(d).alias("last_date"))


@query("with s as (select case when o_orderkey is null then 'no_orders' when c_acctbal < 0 then 'negative_balance' when n_name is null then 'no_nation' else 'usable' end as status from customer left join orders on o_custkey = c_custkey left join nation on n_nationkey = c_nationkey) select status, count(*) n from s group by 1")
def status_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o, n = (table(spark, sf_dir, t) for t in ("customer", "orders", "nation"))
    j = c.join(o, F.col("o_custkey") == F.col("c_custkey"), "left").join(n, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    s = F.when(F.col("o_orderkey").isNull(), "no_orders").when(F.col("c_acctbal") < 0, "negative_balance").when(F.col("n_name").isNull(), "no_nation").otherwise("usable")
    return j.groupBy(s.alias("status")).agg(F.count("*").alias("n"))
