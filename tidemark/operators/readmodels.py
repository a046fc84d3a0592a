"""Read models of a portfolio and its scenarios: one nested row a subject, for a page that shows it.

Lists hold names of a dimension, a fixed number of leaders, or the exposures of one event where they are asked for;
they are built from aggregates, so no list grows with the book.  Money is in whole cents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .portfolio import DIMENSIONS, attribution

#: Shares above which a sector or an obligor is flagged.
SECTOR_LIMIT, OBLIGOR_LIMIT = 0.30, 0.15


def cents(c: Column) -> Column:
    return F.round(c * 100, 0).cast("bigint")


def pct(part: Column, whole: Column, places: int = 4) -> Column:
    """A share in percent, 0 where there is nothing to share.  Rounded as doubles are in SQL: scaled, to a whole number,
    scaled back; what rounds to zero keeps its sign."""
    share = F.try_divide(part.cast("double") * 100, whole.cast("double"))
    whole_number = F.round(share * 10.0**places, 0)
    return F.coalesce(F.when(whole_number == 0, share * 0.0).otherwise(whole_number / 10.0**places), F.lit(0.0))


def _plain(c: Column, kind: T.DataType, names: set[str], name: str = "") -> Column:
    """The same value with its doubles (of at most four decimal places) as text without an exponent; their names are noted."""
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_plain(c[f.name], f.dataType, names, f.name).alias(f.name) for f in kind]))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return F.transform(c, lambda e: _plain(e, kind.elementType, names))
    if not isinstance(kind, T.DoubleType):
        return c
    names.add(name)
    digits = F.regexp_replace(c.try_cast("decimal(38,4)").cast("string"), "0{1,3}$", "")
    return F.when(c == 0, c.cast("string")).otherwise(F.coalesce(digits, c.cast("string")))


def payload(rows: DataFrame, columns: list[str] | None = None) -> Column:
    """The columns as JSON with plain numbers: to_json writes 3.0E-4 where SQL has 0.0003.

    Such numbers go in as text and lose their quotes again.  Quotes inside of strings are escaped, so a name that stands
    in quotes behind a brace or comma is a field's."""
    names: set[str] = set()
    c = F.struct(*[_plain(F.col(f.name), f.dataType, names, f.name).alias(f.name) for f in rows.schema if columns is None or f.name in columns])
    return F.regexp_replace(F.to_json(c), f'([{{,]"(?:{"|".join(sorted(names))})":)"(-?[0-9][0-9.E]*)"', "$1$2") if names else F.to_json(c)


def _listed(rows: DataFrame, by: list[str], fields: list[Column], order: list[Column], name: str) -> DataFrame:
    """One array a group, in order."""
    return rows.select(*by, F.struct(F.struct(*order).alias("o"), F.struct(*fields).alias("f")).alias("e")).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["f"]).alias(name))


def portfolio_overview(exposures: DataFrame, dimensions: list[str] = DIMENSIONS, leaders: int = 5) -> DataFrame:
    """One row: totals, the distribution of each dimension (largest first), the largest obligors, and what is flagged."""
    total = exposures.agg(F.count("*").alias("exposure_count"), F.coalesce(F.sum("ead"), F.lit(0)).alias("ead"), F.coalesce(F.sum(F.col("ead") * F.col("pd") * F.col("lgd")), F.lit(0)).alias("base_el"))
    by_obligor = exposures.groupBy("obligor").agg(F.sum("ead").alias("ead"))
    obligors = by_obligor.agg(F.count("*").alias("obligor_count"))
    slices = exposures.groupingSets([[F.col(d)] for d in dimensions], *dimensions).agg(F.sum("ead").alias("ead"), F.count("*").alias("n"), F.grouping_id(*dimensions).alias("g"))
    full = (1 << len(dimensions)) - 1
    of = F.coalesce(*[F.when(F.col("g") == full - (1 << (len(dimensions) - 1 - k)), d) for k, d in enumerate(dimensions)])
    slices = slices.select(of.alias("dimension"), F.coalesce(*dimensions).alias("name"), "n", "ead").join(F.broadcast(total.select(F.col("ead").alias("whole"))))  # one row
    parts = _listed(slices, ["dimension"], [F.col("name"), F.col("n"), cents(F.col("ead")).alias("ead"), pct(F.col("ead"), F.col("whole")).alias("pct")], [-F.col("ead"), F.col("name")], "slices")
    each = parts.groupBy().pivot("dimension", dimensions).agg(F.first("slices"))
    top = by_obligor.orderBy(F.desc("ead"), "obligor").limit(leaders).join(F.broadcast(total.select(F.col("ead").alias("whole"))))
    top = _listed(top, [], [F.col("obligor"), cents(F.col("ead")).alias("ead"), pct(F.col("ead"), F.col("whole")).alias("pct")], [-F.col("ead"), F.col("obligor")], "top_obligors")
    flagged = slices.filter((F.col("dimension") == "sector") & (F.col("ead").cast("double") > SECTOR_LIMIT * F.col("whole").cast("double"))).select(F.concat(F.lit("sector "), "name").alias("flag"))
    heavy = by_obligor.join(F.broadcast(total.select(F.col("ead").alias("whole")))).filter(F.col("ead").cast("double") > OBLIGOR_LIMIT * F.col("whole").cast("double")).select(F.concat(F.lit("obligor "), "obligor").alias("flag"))
    flags = flagged.union(heavy).agg(F.array_sort(F.collect_list("flag")).alias("flags"))  # at most 1 / 0.15 + 1 / 0.30 rows
    one = total.join(F.broadcast(obligors)).join(F.broadcast(each)).join(F.broadcast(top)).join(F.broadcast(flags))  # a row each
    return one.select(cents(F.col("ead")).alias("total_ead"), cents(F.col("base_el")).alias("base_el"), "exposure_count", "obligor_count", *[F.col(d).alias(f"{d}_distribution") for d in dimensions], "top_obligors", "flags")


def event_overviews(shocks: DataFrame, stressed: DataFrame, exposures: DataFrame, leaders: int = 5) -> DataFrame:
    """One row an event: its status, base and stressed sums over what it affects, their change in percent, and the largest
    affected exposures.  Status is ERROR, NO_EVENT, NO_EXPOSURE or STRESSED."""
    whole = exposures.agg(F.coalesce(F.sum("ead"), F.lit(0)).alias("whole"))
    t = stressed.groupBy("event_id").agg(F.count("*").alias("n"), F.sum("ead").alias("ead"), F.sum("base_el").alias("base"), F.sum("stressed_el").alias("stress"), F.sum("mtm_impact").alias("mtm"))
    ranked = stressed.select("event_id", "exposure_id", "obligor", "ead", "incremental_el", "mtm_impact")
    ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc("ead"), "exposure_id"))).filter(F.col("place") <= leaders)
    top = _listed(ranked, ["event_id"], [F.col("exposure_id"), F.col("obligor"), cents(F.col("ead")).alias("ead"), cents(F.col("incremental_el")).alias("incremental_el"), cents(F.col("mtm_impact")).alias("mtm_impact")], [F.col("place")], "top_exposures")
    j = shocks.join(t, "event_id", "left").join(top, "event_id", "left").join(F.broadcast(whole))  # one row
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    status = F.when(F.col("error").isNotNull(), "ERROR").when(F.col("rule_id").isNull() | F.upper(F.trim("event_type")).eqNullSafe("NO_EVENT"), "NO_EVENT").when(F.col("n").isNull(), "NO_EXPOSURE").otherwise("STRESSED")
    return j.select(
        "event_id", "entity", F.col("scope").alias("shock_scope"), status.alias("status"), zero("n").cast("bigint").alias("n_affected"), cents(zero("ead")).alias("affected_ead"), pct(zero("ead"), F.col("whole")).alias("affected_ead_pct"),
        cents(zero("base")).alias("base_el"), cents(zero("stress")).alias("stressed_el"), cents(zero("stress") - zero("base")).alias("incremental_el"), pct(zero("stress") - zero("base"), zero("base")).alias("incremental_el_pct"),
        cents(zero("mtm")).alias("mtm_impact"), (status == "STRESSED").alias("stress_applied"), F.coalesce("top_exposures", F.array().cast(top.schema["top_exposures"].dataType)).alias("top_exposures"),
    )


def scenario_comparisons(overviews: DataFrame, dims: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row a pair (place, event_a, event_b): both overviews, the differences B minus A, and those of each name of each
    dimension; a name that one side lacks counts zero there."""
    side = lambda x: overviews.select(F.col("event_id").alias(f"event_{x}"), F.struct(*[c for c in overviews.columns if c != "top_exposures"]).alias(f"scenario_{x}"))
    j = pairs.join(side("a"), "event_a").join(side("b"), "event_b")
    of = attribution(dims).select("event_id", "dimension", "name", "incremental_el", "mtm_impact")
    both = pairs.select("place", F.explode(F.array(F.struct(F.col("event_a").alias("event_id"), F.lit(-1).alias("sign")), F.struct(F.col("event_b").alias("event_id"), F.lit(1).alias("sign")))).alias("s")).select("place", "s.*")
    diff = both.join(of, "event_id").groupBy("place", "dimension", "name").agg(F.sum(F.col("sign") * F.col("incremental_el")).alias("el"), F.sum(F.col("sign") * F.abs("mtm_impact")).alias("mtm"))
    lists = _listed(diff, ["place"], [F.col("dimension"), F.col("name"), cents(F.col("el")).alias("incremental_el_difference"), cents(F.col("mtm")).alias("absolute_mtm_difference")], [F.col("dimension"), F.col("name")], "attribution_differences")
    a, b = F.col("scenario_a"), F.col("scenario_b")
    deltas = F.struct((b["affected_ead"] - a["affected_ead"]).alias("affected_ead_difference"), (b["incremental_el"] - a["incremental_el"]).alias("incremental_el_difference"), (F.abs(b["mtm_impact"]) - F.abs(a["mtm_impact"])).alias("absolute_mtm_difference"))
    return j.join(lists, "place", "left").select("place", "scenario_a", "scenario_b", deltas.alias("deltas"), F.coalesce("attribution_differences", F.array().cast(lists.schema["attribution_differences"].dataType)).alias("attribution_differences"))
