"""Ordered clusters where a row lies in the middle between two, against SQL."""

import datetime as dt
import random

import duckdb

from tidemark.plans import registry


def test_ties_of_ordered_clusters(spark, tmp_path):
    """whole values, so that many rows are equally near to two clusters; rows without a value or of an unknown type."""
    rng, day = random.Random(3), dt.datetime(2024, 1, 1)
    kinds = ["error", "purchase", "signup", "click", "view", "other"]
    rows = [(k, day + dt.timedelta(minutes=4 * k), rng.randrange(30), rng.choice(kinds), None if k % 97 == 0 else float(rng.randrange(200))) for k in range(5000)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    con.sql(f"create view events as select * replace (ts::timestamp as ts) from '{tmp_path}/events.parquet/*.parquet'")
    sql = con.sql(registry.oracles()["ordered_clusters"])
    got = registry.queries()["ordered_clusters"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r[c] for c in sql.columns) for r in got) == sorted(sql.fetchall())
