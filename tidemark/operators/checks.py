"""Data-quality checks: one pass each, one row of counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def n(condition: Column, name: str) -> Column:
    return F.count(F.when(condition, 1)).alias(name)


def leaking(df: DataFrame, forbidden: list[str]) -> list[str]:
    """Columns that a model must not see, in order; the schema alone is read."""
    return [c for c in df.columns if c.lower() in forbidden]


def assert_no_leakage(df: DataFrame, forbidden: list[str]) -> DataFrame:
    if found := leaking(df, forbidden):
        raise ValueError(f"columns leak the future: {found}")
    return df


def probabilities(df: DataFrame, parts: list[str], score: str, tolerance: float = 0.01) -> DataFrame:
    """Rows, nulls, probabilities out of [0, 1], sums away from 1 and scores out of [-1, 1]."""
    cols = [F.col(c) for c in parts]
    missing, outside = F.lit(False), F.lit(False)
    for c in cols:
        missing, outside = missing | c.isNull(), outside | ~c.between(0, 1)
    total = sum(cols[1:], cols[0])
    return df.agg(F.count("*").alias("n"), n(missing, "n_null"), n(outside, "n_out_of_range"), n(F.abs(total - 1) > tolerance, "n_bad_sum"), n(~F.col(score).between(-1, 1), "n_bad_score"))


def taxonomy(df: DataFrame, label: str, allowed: list[str], confidence: str, shown: int = 5) -> DataFrame:
    """Rows, labels that are not allowed with some examples, and confidences out of [0, 1]."""
    bad = F.col(label).isNotNull() & ~F.col(label).isin(allowed)
    return df.groupBy(F.when(bad, F.col(label)).alias("bad")).agg(F.count("*").alias("n"), n(F.col(label).isNull(), "n_null"), n(~F.col(confidence).between(0, 1), "n_bad_confidence")).agg(
        F.sum("n").alias("n"), F.sum("n_null").alias("n_null"), F.coalesce(F.sum(F.when(F.col("bad").isNotNull(), F.col("n"))), F.lit(0)).alias("n_bad_label"), F.sum("n_bad_confidence").alias("n_bad_confidence"),
        F.array_join(F.slice(F.array_sort(F.collect_set("bad")), 1, shown), ",").alias("examples"),
    )


def scores(df: DataFrame, score: str, low: float = 1.0, high: float = 10.0) -> DataFrame:
    """Null, NaN, infinite and out-of-range scores; a row may count in several."""
    c = F.col(score)
    endless = F.abs(c) == float("inf")
    return df.agg(F.count("*").alias("n"), n(c.isNull(), "n_null"), n(F.isnan(c), "n_nan"), n(endless & ~F.isnan(c), "n_infinite"), n((c < low) | (c > high), "n_out_of_range"))


def stress_invariants(stressed: DataFrame) -> DataFrame:
    """Stressed rows that break an identity or a bound; all counts should be 0."""
    bad = lambda cond: F.expr(cond)
    return stressed.agg(
        F.count("*").alias("n"),
        n(bad("base_el <> ead * pd * lgd or stressed_el <> ead * stressed_pd * stressed_lgd"), "n_identity"),
        n(bad("incremental_el <> stressed_el - base_el"), "n_difference"),
        n(bad("stressed_pd not between 0 and 1 or stressed_lgd not between 0 and 1 or stressed_pd < pd or stressed_lgd < lgd"), "n_bounds"),
        n(bad("asset_type = 'Equity' and (stressed_pd <> pd or stressed_lgd <> lgd)"), "n_equity_changed"),
        n(bad("abs(mtm_impact) > ead"), "n_market_move"),
    )
