"""Numbers, running lookups and values around events against plain versions."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.operators import evaluate, market, records


def test_numbers_of_a_wide_table(spark):
    """The numbers are gapless and in order whatever columns are read, at many ranges."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        df = spark.range(300_000).select((F.col("id") * 7919 % 1_000_003).alias("k"), F.md5(F.col("id").cast("string")).alias("wide"), F.lit("x").alias("other"))
        got = records.row_ids(df, "k")
        assert got.columns == ["k", "wide", "other", "row_id"]
        n = got.agg(F.min("row_id"), F.max("row_id"), F.countDistinct("row_id"), F.count("wide")).first()
        assert tuple(n) == (0, 299_999, 300_000, 300_000)
        line = got.orderBy("row_id").select("k").toPandas()["k"]
        assert line.is_monotonic_increasing
        with_null = spark.createDataFrame([(2,), (None,), (1,)], "k int")
        assert sorted(tuple(r) for r in records.row_ids(with_null, "k").fillna(0, ["k"]).collect()) == [(0, 0), (1, 1), (2, 2)]
        assert records.row_ids(df.limit(0), "k").count() == 0
        sums = evaluate.cumulative(df.withColumn("g", F.col("k") % 2), ["g"], "k")
        assert sums.filter("n <> 1").count() == 0 and sums.groupBy("g").agg(F.countDistinct("before").alias("d"), F.max("total").alias("t")).filter("d <> t").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_running_last_over_pieces(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(-500, 500), k, rng.randrange(100) if rng.random() < 0.3 else None) for k in range(400)]
    got = market.running_last(spark.createDataFrame(rows, "key string, at long, k long, seen int"), ["key"], "at", ["k"], "seen", "last", 40)
    want, last = [], {}
    for key, at, k, seen in sorted(rows, key=lambda r: (r[1], r[2])):
        last[key] = last.get(key) if seen is None else seen
        want.append((key, at, k, seen, last[key]))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_an_hour_after_the_observation(spark):
    """Bars at 10:00, 11:10 and 11:40; an event at 10:30 falls on 10:00, so 11:10 is the next; days later 11:40 is the last."""
    day = dt.datetime(2024, 3, 1)
    bars = [("A", day.replace(hour=h, minute=m), v) for h, m, v in ((10, 0, 1.0), (11, 10, 2.0), (11, 40, 3.0))]
    events = [(1, "A", day.replace(hour=10, minute=30)), (2, "A", day.replace(hour=9)), (3, "A", day + dt.timedelta(days=4)), (4, "A", day.replace(hour=11, minute=10)), (5, "B", day), (6, "A", day.replace(hour=10, minute=0))]
    got = records.around(spark.createDataFrame(events, "event_id long, key string, at timestamp"), spark.createDataFrame(bars, "key string, ts timestamp, v double"), "key", "at", "ts", "v")
    assert {r.event_id: (r.before, r.after) for r in got.collect()} == {1: (1.0, 2.0), 2: (None, None), 3: (3.0, None), 4: (2.0, None), 5: (None, None), 6: (1.0, 2.0)}
