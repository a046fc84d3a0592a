"""Shock mapping, stress and attribution with exact decimals.

Affected exposures are found by one equi-join: each exposure offers its names, sector, geography and asset class as
keys, and each signal asks for those of its scope, so the book is read once with all its columns and the work follows
the number of affected rows, not signals times exposures.  Signals and the rule table are small by nature and read by
key; only the rule table, of fixed size, is broadcast by hint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.lexicon import CAPABLE, SHOCKS
from tidemark.functions.scoring import clamp

RATE = "decimal(9,6)"


def shock_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SHOCKS, "rule_id string, rule_type string, scope string, pd double, lgd double, bond double, equity double")


def shock_map(signals: DataFrame) -> DataFrame:
    """signals: event_id, event_type, entity, impact. Types count in any case, unknown ones take the catch-all rule; impacts outside 1..10 get an error."""
    rules = F.broadcast(shock_rules(signals.sparkSession))
    known = F.create_map(*[F.lit(x) for r in SHOCKS for x in (r[1].lower(), r[1])])
    s = signals.withColumn("rule_type", F.coalesce(F.try_element_at(known, F.lower(F.trim("event_type"))), F.lit("Other / Unclear")))
    s = s.withColumn("error", F.when(~F.coalesce(F.col("impact"), F.lit(1.0)).between(1, 10), "impact out of range"))
    s = s.join(rules, "rule_type").withColumn("severity", F.round((F.coalesce(F.col("impact"), F.lit(1.0)) - 1) / 9, 6))
    size = lambda c, lo, hi: F.round(clamp(F.col(c) * F.col("severity"), lo, hi), 6).cast(RATE)
    return s.select("event_id", "event_type", "entity", "impact", "error", "rule_id", "scope", "severity", size("pd", 0.0, 1.0).alias("pd_delta"), size("lgd", 0.0, 1.0).alias("lgd_delta"), size("bond", -1.0, 1.0).alias("bond_shock"), size("equity", -1.0, 1.0).alias("equity_shock"))


def _names() -> Column:
    """key, prio of an exposure's names: ticker before obligor before alias."""
    key = lambda c, p: F.struct(F.lower(F.trim(c)).alias("key"), F.lit(p).alias("prio"))
    keys = F.concat(F.array(key(F.col("ticker"), 0), key(F.col("obligor"), 1)), F.coalesce(F.transform("aliases", lambda a: key(a, 2)), F.array().cast("array<struct<key:string,prio:int>>")))
    return F.filter(keys, lambda k: k["key"].isNotNull() & (k["key"] != ""))


def homes(shocks: DataFrame, exposures: DataFrame) -> DataFrame:
    """event_id, scope, sector and geography of the best exposure that a signal's entity names."""
    asked = shocks.filter("error is null and scope in ('SECTOR', 'GEOGRAPHY')").select("event_id", "scope", F.lower(F.trim("entity")).alias("key"))
    named = exposures.select("exposure_id", "sector", "geography", F.explode(_names()).alias("k")).select("exposure_id", "sector", "geography", "k.*")
    first = F.struct("prio", "exposure_id")
    return named.join(asked, "key").groupBy("event_id", "scope").agg(F.min_by("sector", first).alias("sector"), F.min_by("geography", first).alias("geography"))


def affected(shocks: DataFrame, exposures: DataFrame) -> DataFrame:
    """The exposures, with all their columns, in the scope of each valid signal: event_id in front."""
    ok = shocks.filter("error is null")
    same = lambda c: F.lower(F.trim(c))
    asks = lambda rows, kind, key: rows.select("event_id", F.lit(kind).alias("kind"), key.alias("key"))
    home = homes(shocks, exposures)
    broad = ok.filter("scope in ('BROAD_MARKET', 'SYSTEMIC')").select("event_id", F.explode(F.array(*[F.lit(a) for a in CAPABLE])).alias("asset"))
    asked = asks(ok.filter("scope = 'ENTITY'"), "name", same("entity")).union(asks(home.filter("scope = 'SECTOR'"), "sector", same("sector"))).union(asks(home.filter("scope = 'GEOGRAPHY'"), "geography", same("geography"))).union(asks(broad, "asset", F.col("asset")))
    offer = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    offers = F.concat(F.array_distinct(F.transform(_names(), lambda n: offer("name", n["key"]))), F.array(offer("sector", same("sector")), offer("geography", same("geography")), offer("asset", F.col("asset_type"))))
    rows = exposures.select("*", F.explode(offers).alias("__offer")).select(*exposures.columns, "__offer.kind", "__offer.key")
    return rows.join(asked, ["kind", "key"]).select("event_id", *exposures.columns)


def stress(shocks: DataFrame, exposures: DataFrame) -> DataFrame:
    """One row an affected exposure and event, with base and stressed expected loss and market value."""
    rows = affected(shocks, exposures).join(shocks.select("event_id", "rule_id", "pd_delta", "lgd_delta", "bond_shock", "equity_shock"), "event_id")
    can = lambda k: F.col("asset_type").isin([a for a, c in CAPABLE.items() if c[k]])
    one = F.lit(1).cast(RATE)
    pd = F.when(can(0), F.least(one, (F.col("pd") + F.col("pd_delta")).cast(RATE))).otherwise(F.col("pd"))
    lgd = F.when(can(0), F.least(one, (F.col("lgd") + F.col("lgd_delta")).cast(RATE))).otherwise(F.col("lgd"))
    move = F.when(can(1), F.col("bond_shock")).when(can(2), F.col("equity_shock")).otherwise(F.lit(0).cast(RATE))
    rows = rows.withColumn("stressed_pd", pd).withColumn("stressed_lgd", lgd)
    rows = rows.withColumn("base_el", F.col("ead") * F.col("pd") * F.col("lgd")).withColumn("stressed_el", F.col("ead") * F.col("stressed_pd") * F.col("stressed_lgd"))
    return rows.withColumn("incremental_el", F.col("stressed_el") - F.col("base_el")).withColumn("mtm_impact", F.col("ead") * move)


def top_by(stressed: DataFrame, n: int = 5) -> DataFrame:
    """The first exposures of each event by EAD, loss and market move: each branch keeps n rows a task before it shuffles."""
    def branch(name: str, measure) -> DataFrame:
        k = F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc("size"), "exposure_id"))
        rows = stressed.select("event_id", "exposure_id", F.lit(name).alias("measure"), measure.cast("double").alias("size"))
        return rows.withColumn("place", k).filter(F.col("place") <= n)

    return branch("ead", F.col("ead")).union(branch("incremental_el", F.col("incremental_el"))).union(branch("mtm_impact", F.abs("mtm_impact")))


DIMENSIONS = ["sector", "geography", "asset_type"]


def by_dimension(stressed: DataFrame, total: DataFrame) -> DataFrame:
    """One pass over the affected rows for all dimensions (grouping sets). total: one row, total_ead."""
    sets = [[F.col("event_id"), F.col(d)] for d in DIMENSIONS]
    g = stressed.groupingSets(sets, "event_id", *DIMENSIONS).agg(F.count("*").alias("n"), F.sum("ead").alias("ead"), F.sum("incremental_el").alias("incremental_el"), F.sum("mtm_impact").alias("mtm_impact"), F.grouping_id("event_id", *DIMENSIONS).alias("g"))
    name = F.when(F.col("g") == 0b0011, "sector").when(F.col("g") == 0b0101, "geography").otherwise("asset_type")
    g = g.join(F.broadcast(total))
    return g.select("event_id", name.alias("dimension"), F.coalesce(*DIMENSIONS).alias("name"), "n", "ead", "incremental_el", "mtm_impact", (F.col("ead").cast("double") / F.nullif(F.col("total_ead"), F.lit(0.0)) * 100).alias("pct_of_portfolio"))


def attribution(dims: DataFrame) -> DataFrame:
    """Share of each name in its event's and dimension's expected loss and market move; null where the total is 0."""
    w = Window.partitionBy("event_id", "dimension")
    share = lambda c: F.try_divide(F.col(c).cast("double") * 100, F.nullif(F.sum(c).over(w).cast("double"), F.lit(0.0)))
    return dims.select("event_id", "dimension", "name", "ead", "incremental_el", "mtm_impact", share("incremental_el").alias("el_pct"), share("mtm_impact").alias("mtm_pct"))


def totals(shocks: DataFrame, stressed: DataFrame) -> DataFrame:
    t = stressed.groupBy("event_id").agg(F.count("*").alias("n_affected"), F.sum("ead").alias("affected_ead"), F.sum("incremental_el").alias("incremental_el"), F.sum("mtm_impact").alias("mtm_impact"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return shocks.select("event_id", "scope", "error").join(t, "event_id", "left").select("event_id", "scope", "error", *[zero(c) for c in ("n_affected", "affected_ead", "incremental_el", "mtm_impact")])


def compare(total: DataFrame, pairs: DataFrame) -> DataFrame:
    """B minus A for each pair of events (event_a, event_b); further columns of the pairs, such as their place, are kept."""
    side = lambda x: total.select(F.col("event_id").alias(f"event_{x}"), F.col("affected_ead").alias(f"ead_{x}"), F.col("incremental_el").alias(f"el_{x}"), F.col("mtm_impact").alias(f"mtm_{x}"))
    j = pairs.join(side("a"), "event_a").join(side("b"), "event_b")
    return j.select(*pairs.columns, (F.col("ead_b") - F.col("ead_a")).alias("delta_ead"), (F.col("el_b") - F.col("el_a")).alias("delta_el"), (F.abs("mtm_b") - F.abs("mtm_a")).alias("delta_mtm"))


def attribution_diff(dims: DataFrame, event_a: str, event_b: str) -> DataFrame:
    """Full outer join of two events' attributions; a missing side counts zero."""
    side = lambda e, x: dims.filter(F.col("event_id") == e).select("dimension", "name", F.col("incremental_el").alias(f"el_{x}"), F.col("mtm_impact").alias(f"mtm_{x}"))
    j = side(event_a, "a").join(side(event_b, "b"), ["dimension", "name"], "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return j.select("dimension", "name", (zero("el_b") - zero("el_a")).alias("delta_el"), (F.abs(zero("mtm_b")) - F.abs(zero("mtm_a"))).alias("delta_mtm"))
