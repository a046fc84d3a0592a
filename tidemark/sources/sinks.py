"""Sinks: tables as Parquet, JSON lines and CSV, and a report of small aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import swap


def parquet(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    """One directory; with ``by`` one folder a value, so that readers prune."""
    w = df.write.mode(mode)
    (w.partitionBy(*by) if by else w).parquet(path)


def json_lines(df: DataFrame, path: str) -> None:
    """The whole directory is replaced when the job commits; a failed job leaves no part of itself."""
    df.write.mode("overwrite").json(path)


def json_document(df: DataFrame, path: str) -> None:
    """One JSON file with the rows of a small aggregate, in the order of their columns, swapped in by an atomic rename: readers
    get the old document or the new one."""
    row = F.struct(*df.columns)
    text = df.agg(F.to_json(F.array_sort(F.collect_list(row))).alias("t")).first()["t"]  # a report's rows
    swap(df.sparkSession, path, text)


def append_csv(df: DataFrame, path: str) -> None:
    """Each call adds files with a header; earlier ones stay."""
    df.write.mode("append").option("header", True).csv(path)


def _lines(title: str, df: DataFrame, at: int) -> DataFrame:
    """part, line of one section, its rows in the order of all columns."""
    cells = [F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in df.columns]
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    head = "\n".join([f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)])
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*df.columns, row.alias("__row")))), lambda r: r["__row"]), "\n")
    return df.agg(body.alias("body")).select(F.lit(at).alias("at"), F.when(F.col("body") == "", F.lit(head)).otherwise(F.concat(F.lit(head + "\n"), F.col("body"))).alias("text"))


def report(title: str, sections: dict[str, DataFrame]) -> DataFrame:
    """One row, ``report``: a heading and a table a section.

    Sections are aggregates of a few rows (orderable columns); a report of a large table belongs into ``parquet``."""
    parts = reduce(DataFrame.unionByName, [_lines(name, df, at) for at, (name, df) in enumerate(sections.items())])
    whole = parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda r: r["text"]), "\n\n").alias("t"))
    return whole.select(F.concat(F.lit(f"# {title}\n\n"), F.col("t")).alias("report"))
