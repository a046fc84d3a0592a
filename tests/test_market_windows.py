"""Windows of stock, index and sector, price windows of both resolutions, and merged caches, on literal cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import market
from tidemark.sources.keyed import merge_series

DAY = dt.date(2024, 1, 1)


def series(spark, key, closes, start=0, kind="key string, trade_date date, close double"):
    return spark.createDataFrame([(key, DAY + dt.timedelta(days=start + k), float(c)) for k, c in enumerate(closes)], kind)


def test_one_window_for_all_series(spark):
    bars = spark.createDataFrame([("A", DAY + dt.timedelta(days=k), 110.0 if k == 12 else 100.0, 2500 if k == 12 else 0 if k == 3 else 1000) for k in range(13)] + [("B", DAY, 5.0, 1)], "ticker string, trade_date date, close double, volume long")
    index = series(spark, "i", [3800.0] * 12 + [3900.0]).select("trade_date", F.col("close").alias("index_close"))
    funds = series(spark, "late", [50.0, 55.0], start=12).union(series(spark, "old", [10.0, 20.0])).union(series(spark, "zero", [0.0] * 13))
    asked = [(1, "A", DAY + dt.timedelta(days=14), "late"), (2, "A", DAY + dt.timedelta(days=12), "old"), (3, "A", DAY + dt.timedelta(days=12), None), (4, "A", DAY + dt.timedelta(days=5), "zero"), (5, "B", DAY, None), (6, "C", DAY, "old"), (7, "A", DAY - dt.timedelta(days=1), None), (8, "A", DAY + dt.timedelta(days=12), "zero")]
    events = spark.createDataFrame(asked, "event_id long, ticker string, event_date date, fund string")
    got = {r.event_id: r for r in market.event_context(events, bars, index, funds).collect()}
    assert len(got) == 8 and [got[k].status for k in range(1, 9)] == ["OK", "OK", "OK", "SHORT_HISTORY", "SHORT_HISTORY", "NO_BARS", "NO_BARS", "OK"]
    one = got[1]
    assert one.anchor_date == DAY + dt.timedelta(days=12) and one.stock_return == 0.1 and one.index_return == pytest.approx(0.026316) and one.abnormal_return == pytest.approx(0.073684)
    assert one.volume_ratio == round(2500 / (11 * 1000 / 12), 4) and one.volatility == 0.0
    assert one.sector_movement == 0.0  # the series begins in the window: its first close is the base
    assert got[2].sector_movement is None and got[3].sector_movement is None and got[8].sector_movement == 0.0
    assert got[4].stock_return is None
    alone = market.event_context(events, bars, index.limit(0), funds).filter("event_id = 1").first()
    assert alone.index_return is None and alone.abnormal_return == 0.1


def test_two_resolutions(spark):
    at = dt.datetime(2024, 3, 1, 12)
    points = [("A", at + dt.timedelta(hours=h), float(c), c + 1.0, c - 1.0) for h, c in ((-30, 9), (-24, 10), (-1, 12), (0, 0), (23, 15), (24, 99))]
    asked = [(1, "A", at, at), (2, "A", at, at + dt.timedelta(days=55, hours=23)), (3, "A", at, at + dt.timedelta(days=56)), (4, "B", at, at), (5, "A", at + dt.timedelta(hours=23), at)]
    p = spark.createDataFrame(points, "key string, ts timestamp, close double, high double, low double")
    got = {r.event_id: tuple(r)[1:] for r in market.price_windows(spark.createDataFrame(asked, "event_id long, key string, at timestamp, as_of timestamp"), p).collect()}
    assert got[1] == got[2] == ("success", "15m", 4, 10.0, 15.0, 5.0, 50.0, 16.0, -1.0, 17.0)
    # Days: the 29th has 9 and 10 (the last at noon), the first 12 and 0, the second 15 and 99.
    assert got[3] == ("success", "1d", 3, 10.0, 99.0, 89.0, pytest.approx(890.0), 100.0, -1.0, 101.0)
    assert got[4] == ("unavailable", "15m", 0, None, None, None, None, None, None, None)
    assert got[5][3] == 12.0 and got[5][6] == pytest.approx(725.0)


def test_the_last_of_a_time_stays(spark):
    kind = "ticker string, ts int, price double"
    old = spark.createDataFrame([("A", 1, 1.0), ("A", 2, 2.0), ("B", 1, 5.0)], kind)
    new = spark.createDataFrame([("A", 2, 2.5, 1), ("A", 3, 3.0, 1), ("A", 3, 3.5, 2), ("B", 1, 6.0, 1), ("C", 1, 7.0, 1)], f"{kind}, fetched int")
    merged, added = merge_series(old.withColumn("fetched", F.lit(0)), new, ["ticker", "ts"])
    assert sorted((r.ticker, r.ts, r.price) for r in merged.collect()) == [("A", 1, 1.0), ("A", 2, 2.5), ("A", 3, 3.5), ("B", 1, 5.0), ("C", 1, 7.0)]  # B has nothing new
    assert sorted(tuple(r) for r in added.collect()) == [("A", 1), ("C", 1)]
