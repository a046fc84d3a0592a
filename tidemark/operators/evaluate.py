"""Correlations and buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import correlation_p
from tidemark.sources.scratch import stored


def cumulative(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, value, n, before (rows of the group with a smaller value) and total, one row a distinct value.

    Values are counted first; ranges of (group, value) are summed apart and joined by their totals, so no task
    orders a whole group.  The ranged counts are written, since sums and totals must be of one and the same cut."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    line = stored(counts.repartitionByRange(*by, value).withColumn("__part", F.spark_partition_id()))
    group = Window.partitionBy(*by)
    size = line.groupBy(*by, "__part").agg(F.sum("n").alias("__n"))
    start = size.select(*by, "__part", (F.sum("__n").over(group.orderBy("__part")) - F.col("__n")).alias("__start"), F.sum("__n").over(group).alias("total"))
    inside = F.sum("n").over(Window.partitionBy(*by, "__part").orderBy(value)) - F.col("n")
    return line.withColumn("__in", inside).join(start, [*by, "__part"]).select(*by, value, "n", (F.col("__start") + F.col("__in")).alias("before"), "total")


def quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Interpolated quantiles of each group, exact, from cumulative counts."""
    at = lambda k: F.min(F.when(F.col("before") + F.col("n") > k, F.col(value)))
    place = {name: q * (F.col("total") - 1) for name, q in shares.items()}
    ends = [x for name, p in place.items() for x in (at(F.floor(p)).alias(f"{name}__lo"), at(F.ceil(p)).alias(f"{name}__hi"))]
    g = cumulative(df, by, value).groupBy(*by, "total").agg(*ends)
    between = lambda name: F.col(f"{name}__lo") + (place[name] - F.floor(place[name])) * (F.col(f"{name}__hi") - F.col(f"{name}__lo"))
    return g.select(*by, *[between(name).alias(name) for name in shares])


def spearman(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """n and rho of each group, over rows where both values are there; ties have their average rank, and rho is null where all
    values of a side tie."""
    rows = df.select(*by, a, b).filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    rank = lambda c, name: cumulative(rows, by, c).select(*by, c, (F.col("before") + (F.col("n") + 1) / 2.0).alias(name))
    ranked = rows.join(rank(a, "__a"), [*by, a]).join(rank(b, "__b"), [*by, b])
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.try_divide(F.covar_pop("__a", "__b"), F.stddev_pop("__a") * F.stddev_pop("__b")).alias("rho"))


def rank_correlations(df: DataFrame, by: list[str], predictor: str, target: str) -> DataFrame:
    """n, and rho and its two-sided p for the signed target and for its size; null below five rows."""
    signed = spearman(df, by, predictor, target).select(*by, "n", F.col("rho").alias("rho_signed"))
    size = spearman(df.withColumn("__size", F.abs(target)), by, predictor, "__size").select(*by, F.col("rho").alias("rho_abs"))
    enough = lambda c: F.when(F.col("n") >= 5, F.col(c)).alias(c)
    p = lambda c: correlation_p(F.col(c), F.col("n")).alias(c.replace("rho", "p"))
    return signed.join(size, by).select(*by, "n", enough("rho_signed"), p("rho_signed"), enough("rho_abs"), p("rho_abs"))


def horizon_stats(df: DataFrame, by: list[str], horizons: list[str]) -> DataFrame:
    """For each group and horizon: how many values there are, their mean and median, and those of their sizes.

    Horizons become rows first, so all of them are counted in the same passes."""
    each = df.select(*by, F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(h).cast("double").alias("x")) for h in horizons])).alias("h")).select(*by, "h.horizon", "h.x")
    keys = [*by, "horizon"]
    each = each.withColumn("size", F.abs("x"))
    mean = each.groupBy(*keys).agg(F.count("*").alias("rows"), F.count("x").alias("n"), F.avg("x").alias("mean"), F.avg("size").alias("abs_mean"))
    middle = lambda c, name: quantiles(each, keys, c, {name: 0.5})
    return mean.join(middle("x", "median"), keys, "left").join(middle("size", "abs_median"), keys, "left").select(*keys, "rows", "n", "mean", "median", "abs_mean", "abs_median")


def quantile_buckets(df: DataFrame, value: str, k: int) -> DataFrame:
    """Adds ``bucket``: right-closed quantile bins with equal edges merged."""
    shares = {f"q{i}": i / k for i in range(k + 1)}
    edges = quantiles(df, [], value, shares).select(F.array_distinct(F.array(*shares)).alias("q"))
    inner = F.slice("q", 2, F.greatest(F.size("q") - 2, F.lit(0)))
    return df.join(F.broadcast(edges)).withColumn("bucket", F.size(F.filter(inner, lambda e: e < F.col(value)))).drop("q")  # one row of edges


def bucket_stats(df: DataFrame, value: str, target: str, k: int) -> DataFrame:
    """bucket, count, mean, median and std (sample) of the target over the quantile buckets of a value; rows without
    either don't count."""
    rows = quantile_buckets(df.select(value, target).filter(F.col(value).isNotNull() & F.col(target).isNotNull()), value, k)
    rows = stored(rows.select("bucket", F.col(target).cast("double").alias("x")))
    middle = quantiles(rows, ["bucket"], "x", {"median": 0.5})
    return rows.groupBy("bucket").agg(F.count("*").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std")).join(middle, "bucket")
