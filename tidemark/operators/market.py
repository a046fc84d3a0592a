"""Daily bars, as-of anchors and event windows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def daily_bars(ticks: DataFrame, ticker: str, ts: str, seq: str, price: str) -> DataFrame:
    """ticker, trade_date, close (last price of the day), volume (ticks)."""
    day = ticks.withColumn("trade_date", F.to_date(ts))
    return day.groupBy(F.col(ticker).alias("ticker"), "trade_date").agg(F.max_by(price, F.struct(ts, seq)).alias("close"), F.count("*").alias("volume"))


DAY = 86_400_000_000


def running_last(rows: DataFrame, key: list[str], at: str, order: list[str], seen: str, name: str, width: int = DAY) -> DataFrame:
    """Adds ``name``: the last ``seen`` that is not null, up to and with the row itself, in the order of ``at`` (a whole
    number) and ``order`` inside the key.

    A key's history is cut into pieces of ``width``.  Each piece finds its own last values and is one task's work; only
    the last value of each piece is carried over the key's pieces, so no task sorts a whole history."""
    line = rows.withColumn("__piece", F.floor(F.col(at) / width))
    inside = Window.partitionBy(*key, "__piece").orderBy(at, *order).rowsBetween(Window.unboundedPreceding, 0)
    ends = line.groupBy(*key, "__piece").agg(F.max_by(seen, F.when(F.col(seen).isNotNull(), F.struct(at, *order))).alias("__end"))
    over = Window.partitionBy(*key).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*[F.col(k).alias(f"__{k}") for k in key], F.col("__piece").alias("__p"), F.last("__end", ignorenulls=True).over(over).alias("__carried")).filter("__carried is not null")
    found = line.withColumn("__own", F.last(seen, ignorenulls=True).over(inside))
    same = F.col("__piece") == F.col("__p")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return found.join(carried, same, "left").select(*rows.columns, F.coalesce("__own", "__carried").alias(name))


def as_of(events: DataFrame, bars: DataFrame) -> DataFrame:
    """The last bar at or before each event's date, by ticker: one union and a running last, cut by years.

    events: event_id, ticker, event_date."""
    b = bars.select("ticker", F.unix_date("trade_date").alias("d"), F.lit(0).alias("k"), F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("date").alias("event_date"), F.struct("trade_date", "close").alias("bar"))
    e = events.select("ticker", F.unix_date("event_date").alias("d"), F.lit(1).alias("k"), F.col("event_id").cast("long"), "event_date", F.lit(None).cast(b.schema["bar"].dataType).alias("bar"))
    found = running_last(b.unionByName(e), ["ticker"], "d", ["k"], "bar", "found", 365).filter("k = 1")
    return found.select("event_id", "ticker", "event_date", F.col("found.trade_date").alias("anchor_date"), F.col("found.close").alias("anchor_close"))


def windows(bars: DataFrame, index: DataFrame, size: int = 1, baseline: int = 20, least: int = 10, returns: int = 20) -> DataFrame:
    """For every bar as the end of an event window: its return, volume ratio, volatility and abnormal return.

    bars: ticker, trade_date, close, volume; index: trade_date, index_close. Values are null without enough history.
    The volatility is that of the log returns between the last ``returns`` closes before the window."""
    line = Window.partitionBy("ticker").orderBy("trade_date")
    before = line.rowsBetween(-size - baseline + 1, -size)
    log = F.when((F.col("close") > 0) & (F.lag("close").over(line) > 0), F.log(F.col("close") / F.lag("close").over(line)))
    b = bars.join(index, "trade_date", "left").withColumn("log_return", log)
    b = b.withColumn("n_base", F.count(F.lit(1)).over(before)).withColumn("prior", F.lag("close", size).over(line)).withColumn("index_prior", F.lag("index_close", size).over(line))
    ret = F.when(F.col("prior") == 0, 0.0).otherwise(F.col("close") / F.col("prior") - 1)
    index_ret = F.when(F.col("index_prior") == 0, 0.0).otherwise(F.col("index_close") / F.col("index_prior") - 1)
    ratio = F.try_divide(F.avg("volume").over(line.rowsBetween(-size + 1, 0)), F.avg("volume").over(before))
    vol = F.stddev_samp("log_return").over(line.rowsBetween(-size - returns + 2, -size)) * math.sqrt(252)
    ok = F.col("n_base") >= least
    return b.select("ticker", "trade_date", "n_base", F.when(ok, ret).alias("window_return"), F.when(ok, ratio).alias("volume_ratio"), F.when(ok, vol).alias("volatility"), F.when(ok, ret - F.coalesce(index_ret, F.lit(0.0))).alias("abnormal_return"))


def series_returns(asked: DataFrame, series: DataFrame, name: str) -> DataFrame:
    """event_id and ``name``: the return of each event's series over its window: the last close inside it over the last one
    before it, or over the first one inside where there is none before.  Null without a close inside, 0 over a close of 0.

    asked: event_id, key, first_date, last_date; series: key, trade_date, close, one a key and date."""
    bars = series.select(F.col("key").alias("ticker"), "trade_date", "close", F.lit(0).alias("volume"))
    at = lambda day, c: as_of(asked.select("event_id", F.col("key").alias("ticker"), day.alias("event_date")), bars).select("event_id", F.col("anchor_date").alias(f"{c}_date"), F.col("anchor_close").alias(c))
    opening = series.groupBy("key").agg(F.min_by("close", "trade_date").alias("opening"))
    j = asked.join(at(F.col("last_date"), "end"), "event_id").join(at(F.date_sub("first_date", 1), "prior"), "event_id").join(opening, "key", "left")
    base = F.when(F.col("prior_date").isNotNull(), F.col("prior")).otherwise(F.col("opening"))
    ret = F.when(F.col("end_date") >= F.col("first_date"), F.when(base == 0, 0.0).otherwise((F.col("end") - base) / base))
    return j.select("event_id", ret.alias(name))


def event_context(events: DataFrame, bars: DataFrame, index: DataFrame, funds: DataFrame, size: int = 1, baseline: int = 20, least: int = 10, returns: int = 20) -> DataFrame:
    """The market around each event: its anchor, returns of stock, index and sector over one and the same window, volume
    ratio and volatility.  status is NO_BARS, SHORT_HISTORY or OK; values are null unless it is OK.

    events: event_id, ticker, event_date, fund (null: none); bars: ticker, trade_date, close, volume; index: trade_date,
    index_close; funds: key, trade_date, close.  The volume ratio is the anchor day's over the baseline's mean, null where
    either is 0; without an index the abnormal return is the stock's."""
    line = Window.partitionBy("ticker").orderBy("trade_date")
    before = line.rowsBetween(-size - baseline + 1, -size)
    log = F.when((F.col("close") > 0) & (F.lag("close").over(line) > 0), F.log(F.col("close") / F.lag("close").over(line)))
    volume = F.when(F.col("volume") != 0, F.col("volume"))
    b = bars.withColumn("log_return", log).withColumn("n_base", F.count(F.lit(1)).over(before)).withColumn("prior", F.lag("close", size).over(line))
    b = b.withColumn("first_date", F.coalesce(F.lag("trade_date", size - 1).over(line), F.first("trade_date").over(line)))
    b = b.withColumn("ratio", F.try_divide(volume.cast("double"), F.avg("volume").over(before))).withColumn("volatility", F.stddev_samp("log_return").over(line.rowsBetween(-size - returns + 2, -size)) * math.sqrt(252))
    b = b.withColumn("stock", F.when(F.col("prior") == 0, 0.0).otherwise((F.col("close") - F.col("prior")) / F.col("prior"))).select("ticker", "trade_date", "first_date", "n_base", "ratio", "volatility", "stock")
    anchored = as_of(events, bars).select("event_id", "ticker", F.col("anchor_date").alias("trade_date")).join(b, ["ticker", "trade_date"], "left").withColumn("ok", F.coalesce(F.col("n_base") >= least, F.lit(False)))
    window = anchored.filter("ok").select("event_id", "first_date", F.col("trade_date").alias("last_date"))
    of_index = series_returns(window.withColumn("key", F.lit("index")), index.select(F.lit("index").alias("key"), "trade_date", F.col("index_close").alias("close")), "index_return")
    of_fund = series_returns(window.join(events.filter("fund is not null").select("event_id", F.col("fund").alias("key")), "event_id"), funds, "sector_movement")
    j = anchored.join(of_index, "event_id", "left").join(of_fund, "event_id", "left")
    six = lambda c: F.round(F.when(F.col("ok"), F.col(c)), 6)
    status = F.when(F.col("trade_date").isNull(), "NO_BARS").when(F.col("ok"), "OK").otherwise("SHORT_HISTORY")
    return j.select("event_id", "ticker", F.col("trade_date").alias("anchor_date"), status.alias("status"), six("stock").alias("stock_return"), six("index_return").alias("index_return"), F.round(F.when(F.col("ok"), F.col("stock") - F.coalesce(F.round("index_return", 6), F.lit(0.0))), 6).alias("abnormal_return"), six("sector_movement").alias("sector_movement"), F.round(F.when(F.col("ok"), F.col("ratio")), 4).alias("volume_ratio"), six("volatility").alias("volatility"))


def price_windows(events: DataFrame, points: DataFrame, hours: float = 24, old_days: int = 55, wide_days: int = 5) -> DataFrame:
    """Prices around each event: fine points within ``hours`` of it, or days within ``wide_days`` where the event is more
    than ``old_days`` before ``as_of``.  points: key, ts, close, high, low; events: event_id, key, at, as_of.

    One row an event: status (success or unavailable), interval, n_points, first and last price, their change and its
    percentage (0 over a price of 0), highest, lowest and range.  A day is the last close and the extremes of its points.
    The join is by day, so an event meets only the points of the days around it."""
    old = F.col("as_of") > F.col("at") + F.make_interval(days=F.lit(old_days + 1)) - F.expr("interval 1 microsecond")
    e = events.withColumn("at", F.col("at").cast("timestamp")).withColumn("as_of", F.col("as_of").cast("timestamp")).withColumn("interval", F.when(old, "1d").otherwise("15m"))
    p = points.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("day", F.to_date("ts"))
    fine = p.select("key", "day", F.lit("15m").alias("interval"), "ts", "close", "high", "low")
    daily = p.groupBy("key", "day").agg(F.max_by("close", "ts").alias("close"), F.max("high").alias("high"), F.min("low").alias("low")).select("key", "day", F.lit("1d").alias("interval"), F.col("day").cast("timestamp").alias("ts"), "close", "high", "low")
    reach = F.when(F.col("interval") == "1d", wide_days * 24.0).otherwise(float(hours)) * 3_600_000_000
    e = e.withColumn("lo", F.timestamp_micros((F.unix_micros("at") - reach).cast("bigint"))).withColumn("hi", F.timestamp_micros((F.unix_micros("at") + reach).cast("bigint")))
    asked = e.select("event_id", "key", "interval", "lo", "hi", F.explode(F.sequence(F.to_date("lo"), F.to_date("hi"))).alias("day"))
    inside = asked.join(fine.union(daily), ["key", "interval", "day"]).filter((F.col("ts") >= F.col("lo")) & (F.col("ts") < F.col("hi")))
    g = inside.groupBy("event_id").agg(F.count("*").alias("n_points"), F.min_by("close", "ts").alias("first_price"), F.max_by("close", "ts").alias("last_price"), F.max("high").alias("high_price"), F.min("low").alias("low_price"))
    change = F.col("last_price") - F.col("first_price")
    pct = F.when(F.col("first_price") == 0, 0.0).otherwise(change / F.col("first_price") * 100)
    status = F.when(F.col("n_points").isNull(), "unavailable").otherwise("success")
    return e.select("event_id", "interval").join(g, "event_id", "left").select("event_id", status.alias("status"), "interval", F.coalesce("n_points", F.lit(0)).alias("n_points"), "first_price", "last_price", change.alias("abs_change"), F.when(F.col("n_points").isNotNull(), pct).alias("change_pct"), "high_price", "low_price", (F.col("high_price") - F.col("low_price")).alias("max_range"))
