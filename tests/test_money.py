"""Amounts of money against DuckDB's format."""

import random

import duckdb
from pyspark.sql import functions as F

from tidemark.functions.text import money
from tidemark.plans import registry


def test_money_is_rounded_by_the_exact_value(spark):
    """318.325 lies below its decimal, 0.125 is a tie and goes to the even digit; carries, huge and missing values."""
    rng = random.Random(5)
    values = [318.325, -318.325, 0.125, 0.375, 2.675, 1.005, 0.015, 0.005, 0.004999999999999999, 0.995, 999.995, 999.994999, 999999.9995, 1000.0005, 1000.0625, 1.0625e6, 1e-300, 0.0, -0.0, -0.001, 0.0038, 0.00390625]
    values += [1e15 + 0.3, 2.0**53, 2.0**53 * 1e9, 2.0**63, 1e22, 1e23, 1e32, 1.7e45, 9.999e45, float("inf"), float("-inf"), float("nan"), None]
    values += [rng.choice((1, -1)) * (rng.randrange(200_000) + 0.5) / 10 ** rng.choice((2, 3)) * 10 ** rng.choice((0, 3, 6, 9)) for _ in range(6000)] + [rng.uniform(0, 1e4) * 10.0 ** rng.randrange(-6, 20) for _ in range(3000)]
    got = {r.k: r.m for r in spark.createDataFrame(list(enumerate(values)), "k long, x double").select("k", money(F.col("x")).alias("m")).collect()}
    con = duckdb.connect()
    con.sql("create table orders (o_orderkey bigint, o_totalprice double)")
    con.executemany("insert into orders values (?, ?)", [(4 * k, v) for k, v in enumerate(values)])  # times 1.00073
    sql = registry.oracles()["money_format"].replace("1.00073::double", "1::double")  # the values as they are
    want = {k // 4: m for k, m in con.sql(sql).fetchall()}
    assert {k: (values[k], m) for k, m in got.items() if m != want[k]} == {}
