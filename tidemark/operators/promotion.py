"""Promotion of finished runs: a batch settled in order, two tables changed by one commit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ingest import first_come
from tidemark.sources.scratch import stored
from tidemark.sources.store import Store

RUNS = "run_id string, mode string, event_ids array<string>"
EVENTS = "event_id string, run_id string, mode string"


def settled(candidates: DataFrame, promoted_runs: DataFrame, promoted_events: DataFrame, fixtures: DataFrame) -> DataFrame:
    """candidates, each with an ``outcome``.  candidates: seq (unique, the order), run_id, mode, status, signals and
    results (ids of events); promoted_runs: run_id; promoted_events: event_id, mode; fixtures: event_id.

    A run must be COMPLETED, have signals and results, as many of one as of the other and the same ids in the same
    places.  A run that is promoted already stays as it is.  An event of the fixtures, one that is promoted under
    another mode, and one that an earlier run of the batch takes are collisions, and a run with any is rejected whole;
    a rejected run takes nothing."""
    seen = promoted_runs.select("run_id").distinct().withColumn("known", F.lit(True))
    rows = candidates.join(seen, "run_id", "left")
    events = rows.select("seq", "mode", F.explode(F.array_distinct("signals")).alias("event_id"))
    in_fixtures = events.join(fixtures.select("event_id").distinct(), "event_id").select("seq")
    other = events.join(promoted_events.select("event_id", F.col("mode").alias("old_mode")), "event_id").filter(~F.col("old_mode").eqNullSafe(F.col("mode"))).select("seq")
    hits = in_fixtures.union(other).distinct().withColumn("hit", F.lit(True))
    rows = rows.join(hits, "seq", "left")
    first = F.when(~F.col("status").eqNullSafe("COMPLETED"), "rejected: status").when(F.col("signals").isNull() | F.col("results").isNull(), "rejected: shape").when(F.col("known"), "already promoted")
    first = first.when(F.size("signals") != F.size("results"), "rejected: mismatch").when(F.col("hit"), "rejected: collision").when(F.col("signals") != F.col("results"), "rejected: mismatch")
    rows = rows.withColumn("first", first)
    able = rows.filter("first is null")
    keys = able.select("seq", F.explode(F.concat(F.array(F.concat(F.lit("run:"), "run_id")), F.transform(F.array_distinct("signals"), lambda e: F.concat(F.lit("event:"), e)))).alias("key"))
    won = first_come(keys).withColumn("won", F.lit(True))
    rows = rows.join(won, "seq", "left")
    # A run that an earlier candidate of the batch promoted is promoted already, whatever else is wrong with this one.
    now = rows.filter("won").select(F.col("run_id").alias("r"), F.col("seq").alias("s"))
    rows = rows.join(now, (F.col("run_id") == F.col("r")) & (F.col("s") < F.col("seq")), "left")
    early = F.col("first").isNull() | ~F.col("first").isin("rejected: status", "rejected: shape")
    out = F.when(F.col("s").isNotNull() & early, "already promoted").otherwise(F.coalesce("first", F.when(F.col("won"), "promoted").otherwise("rejected: collision")))
    return rows.select(*candidates.columns, out.alias("outcome"))


def promote(store: Store, candidates: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Settle a batch and make its runs and their events current together; the outcomes.

    An event that was promoted under the same mode goes to the new run."""
    runs, events = store.read("promoted_runs", RUNS), store.read("promoted_events", EVENTS)
    done = stored(settled(candidates, runs, events, fixtures))
    won = done.filter("outcome = 'promoted'")
    new_events = won.select(F.explode(F.array_distinct("signals")).alias("event_id"), "run_id", "mode")
    tables = {
        "outcomes": done.select("seq", "run_id", "outcome"),
        "promoted_runs": runs.unionByName(won.select("run_id", "mode", F.col("signals").alias("event_ids"))),
        "promoted_events": events.join(new_events.select("event_id"), "event_id", "left_anti").select("event_id", "run_id", "mode").unionByName(new_events),
    }
    store.commit(tables, {"promoted_events": {"no_event": F.col("event_id").isNull()}})
    return store.read("outcomes")


def catalog(fixtures: DataFrame, promoted_events: DataFrame, results: DataFrame) -> DataFrame:
    """All events that are shown, with their result: the fixtures first, then the promoted ones with their provenance.
    fixtures: event_id; results: event_id and its columns; events without a result are left out."""
    listed = fixtures.select("event_id", F.lit("FIXTURE").alias("listed_as"), F.lit(None).cast("string").alias("provenance"))
    more = promoted_events.select("event_id", F.lit("PROMOTED").alias("listed_as"), F.col("mode").alias("provenance"))
    return listed.unionByName(more).join(results, "event_id")
