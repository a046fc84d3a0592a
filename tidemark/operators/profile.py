"""A profile of all columns of a table from one scan.

Each value becomes a row (column, bucket) with counts that merge: the number of values, their sum and sum of squares,
the smallest and the largest.  They are combined before the one shuffle, so what is shuffled is the buckets of each
task, not the rows.  A bucket of a number is its sign and its first three digits, so counts, sums and bounds are exact
and a quantile is below the true one by less than one part in a hundred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUANTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
#: Numbers are profiled as whole ten-thousandths.
UNIT = 10_000


def _bucket(x: Column) -> Column:
    """The lower edge, in absolute terms, of the numbers that share sign, length and first three digits."""
    digits = F.abs(x).cast("string")
    rest = F.greatest(F.length(digits) - 3, F.lit(0))
    edge = F.rpad(F.substring(digits, 1, 3), F.least(F.length(digits), F.lit(3)) + rest, "0").cast("bigint")
    return F.when(x < 0, -edge).otherwise(edge)


def profile(df: DataFrame, quantiles: dict[str, float] = QUANTILES) -> DataFrame:
    """column, type, n, n_null, and for numbers low, high, mean, std (sample) and quantiles; for other columns low and high
    are null.  Columns of numbers beyond 9e14 are out of range and an error; arrays, maps and structs count nulls only."""
    number = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
    cells = []
    for field in df.schema:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, number):
            c = F.when(~F.isnan(c.cast("double")), c)
            scaled = F.round(c.cast("decimal(38,6)") * UNIT, 0).cast("bigint")
        else:
            scaled = F.lit(None).cast("bigint")
        cells.append(F.struct(F.lit(field.name).alias("column"), F.lit(field.dataType.simpleString()).alias("type"), c.isNotNull().alias("there"), scaled.alias("x")))
    each = df.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")
    x = F.col("x")
    counts = each.groupBy("column", "type", _bucket(x).alias("bucket")).agg(
        F.count("*").alias("n"), F.sum((~F.col("there")).cast("long")).alias("n_null"), F.count("x").alias("n_num"), F.sum(x.cast("decimal(19,0)")).alias("s"), F.sum(x.cast("decimal(19,0)") * x.cast("decimal(19,0)")).alias("s2"), F.min("x").alias("low"), F.max("x").alias("high"),
    )
    upto = Window.partitionBy("column").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # some thousand buckets a column
    counts = counts.withColumn("upto", F.sum("n_num").over(upto)).withColumn("all", F.sum("n_num").over(Window.partitionBy("column")))
    at = lambda q: F.min(F.when((F.col("all") > 0) & (F.col("upto") >= F.greatest(F.ceil(F.col("all") * q), F.lit(1))), F.col("bucket"))) / UNIT
    n, s, s2 = F.sum("n_num"), F.sum("s").cast("double"), F.sum("s2").cast("double")
    spread = (s2 - s * s / n) / (n - 1)
    out = counts.groupBy("column", "type").agg(
        F.sum("n").alias("n"), F.sum("n_null").alias("n_null"), (F.min("low") / UNIT).alias("low"), (F.max("high") / UNIT).alias("high"),
        F.when(n > 0, s / n / UNIT).alias("mean"), F.when(n > 1, F.sqrt(F.greatest(spread, F.lit(0.0))) / UNIT).alias("std"), *[at(q).alias(name) for name, q in quantiles.items()],
    )
    return out
