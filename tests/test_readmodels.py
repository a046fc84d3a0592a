"""Payloads of the read models where shares are tiny or huge, against DuckDB."""

import duckdb
from pyspark.sql import functions as F

from tidemark.operators import readmodels
from tidemark.plans import registry

def book(spark, sizes):
    """An exposure an obligor; rates in the fields that the read models ask for."""
    rows = [(k, f'O{k} ,"pct":"2"', "S", "G", "Equity", str(size), "0.02", "0.45") for k, size in enumerate(sizes)]
    e = spark.createDataFrame(rows, "exposure_id long, obligor string, sector string, geography string, asset_type string, ead string, pd string, lgd string")
    return e.withColumns({"ead": F.col("ead").cast("decimal(18,2)"), "pd": F.col("pd").cast("decimal(9,6)"), "lgd": F.col("lgd").cast("decimal(9,6)")})


def test_small_shares_have_no_exponent(spark):
    """obligors of 0.0003 % and 0.00005 % beside a large one."""
    one = readmodels.portfolio_overview(book(spark, ["1000000.00", "3.00", "0.50"]))
    got = one.select(readmodels.payload(one).alias("p")).first().p
    assert '"ead":300,"pct":0.0003}' in got and '"ead":50,"pct":0.0}' in got and "E-" not in got
    assert '"obligor":"O1 ,\\"pct\\":\\"2\\"","ead"' in got  # names stay as they are


def test_shares_as_in_sql(spark):
    """The share and its text for parts that round at a five, are negative, or far above the whole."""
    parts = [(k, float(a), float(b)) for k, (a, b) in enumerate([(1.5, 1e6), (2.5, 1e6), (0.35, 1e6), (1, 3), (-1, 3), (-1e-9, 1), (0, -1), (0, 0), (1e9, 3), (2e6, 1), (0.9, 1e5), (7, 1), (1e-3, 1)])]
    parts += [(100 + k, 0.5 + k, 1e6) for k in range(4000)]
    df = spark.createDataFrame(parts, "k long, a double, b double").select("k", readmodels.pct(F.col("a"), F.col("b")).alias("pct"))
    got = {r.k: r.p for r in df.select("k", readmodels.payload(df, ["pct"]).alias("p")).collect()}
    con = duckdb.connect()
    con.execute("create table t (k bigint, a double, b double)")
    con.executemany("insert into t values (?, ?, ?)", parts)
    want = dict(con.execute("select k, to_json({'pct': coalesce(round(a * 100 / nullif(b, 0), 4), 0.0)})::varchar from t").fetchall())
    assert got == want


def tables(spark, folder):
    """Nine customers; the one that events E1 and E5 name has a share of 0.0003 % of all orders."""
    day = "timestamp '2024-01-01 00:00:00'"
    spark.sql(f"select id as o_orderkey, id % 9 + 6 as o_custkey, 'F' as o_orderstatus, if(id % 9 = 1, 6.0D, 250000.0D + id) as o_totalprice, {day} as o_orderdate, concat(id % 5 + 1, '-X') as o_orderpriority from range(36)").write.parquet(f"{folder}/orders.parquet")
    spark.sql("select id + 6 as c_custkey, concat('Customer#', lpad(id + 6, 9, '0')) as c_name, cast(id % 3 as int) as c_nationkey, 0.0D as c_acctbal, concat('S', id % 2) as c_mktsegment from range(9)").write.parquet(f"{folder}/customer.parquet")
    spark.sql("select cast(id as int) as n_nationkey, concat('N', id) as n_name, cast(id % 2 as int) as n_regionkey from range(3)").write.parquet(f"{folder}/nation.parquet")
    spark.sql("select cast(id as int) as r_regionkey, concat('R', id) as r_name from range(2)").write.parquet(f"{folder}/region.parquet")


def equals_sql(spark, folder, name):
    tables(spark, folder)
    con = duckdb.connect()
    for t in ("orders", "customer", "nation", "region"):
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    df, sql = registry.queries()[name](spark, str(folder)), con.sql(registry.oracles()[name])
    got = sorted(tuple(r[c] for c in sql.columns) for r in df.collect())
    assert got == sorted(sql.fetchall())
    return str(got)


def test_event_overviews_equal_sql(spark, tmp_path):
    """an event that touches little of the book."""
    assert '"affected_ead_pct":0.0003,' in equals_sql(spark, tmp_path, "event_overviews")


def test_scenario_comparisons_equal_sql(spark, tmp_path):
    """the same event as one side of a pair."""
    assert '"affected_ead_pct":0.0003,' in equals_sql(spark, tmp_path, "scenario_comparisons")
