"""Raw observation files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Columns of the raw file; those that must never reach a model.
COLUMNS = ["TWEET", "STOCK", "DATE", "LAST_PRICE", "1_DAY_RETURN", "2_DAY_RETURN", "3_DAY_RETURN", "7_DAY_RETURN", "PX_VOLUME", "VOLATILITY_10D", "VOLATILITY_30D", "LSTM_POLARITY", "TEXTBLOB_POLARITY"]
LEAKAGE = ["1_DAY_RETURN", "2_DAY_RETURN", "3_DAY_RETURN", "7_DAY_RETURN", "LSTM_POLARITY", "TEXTBLOB_POLARITY"]


def read_quoted(spark: SparkSession, path: str) -> DataFrame:
    """Quoted CSV with line feeds inside fields; malformed rows are dropped; numbers and day-first dates that don't parse are null."""
    raw = spark.read.schema(", ".join(f"`{c}` string" for c in COLUMNS)).csv(path, header=True, multiLine=True, quote='"', escape='"', mode="DROPMALFORMED")
    num = [c for c in COLUMNS if c not in ("TWEET", "STOCK", "DATE")]
    return raw.select("TWEET", "STOCK", F.expr("cast(try_to_timestamp(DATE, 'dd/MM/yyyy') as date)").alias("DATE"), *[F.expr(f"try_cast(`{c}` as double)").alias(c) for c in num])


def join_lines(lines: DataFrame, file: str, number: str, line: str) -> DataFrame:
    """Rebuild records from unquoted lines: a line that starts like metadata (13 or 14 fields, the first empty or a
    quote, the third a date) ends the text lines before it.  Files are rebuilt side by side, each in line order."""
    parts = F.split(line, ",")
    meta = F.size(parts).isin(13, 14) & F.trim(parts[0]).isin("", '"') & F.coalesce(F.get(parts, 2), F.lit("")).rlike("^\\d{2}/\\d{2}/\\d{4}$")
    w = Window.partitionBy(file).orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    rows = lines.withColumn("__m", meta).withColumn("record", F.coalesce(F.sum(F.col("__m").cast("int")).over(w), F.lit(0)))
    texts = F.array_sort(F.collect_list(F.when(~F.col("__m"), F.struct(number, line))))
    out = rows.groupBy(file, "record").agg(F.concat_ws("\n", F.transform(texts, lambda t: t[line])).alias("text"), F.max(F.when(F.col("__m"), F.col(line))).alias("metadata"))
    return out.filter("metadata is not null")


def without_leakage(df: DataFrame) -> DataFrame:
    return df.drop(*LEAKAGE)
