"""Row adapters, projections, samples and run records: narrow plans, joins and one-pass aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.market import running_last
from tidemark.sources.scratch import stored


def row_ids(df: DataFrame, order: str, name: str = "row_id") -> DataFrame:
    """Gapless numbers from 0 in the order of a unique column, without one task for all rows.

    The keys alone are ranged and written once, so that the ranges, their sizes and the numbers inside them are of one
    and the same cut; the numbers go to the rows by an equi-join.  Nulls come first."""
    keys = stored(df.select(F.col(order).alias("__key")).repartitionByRange("__key").withColumn("__part", F.spark_partition_id()))
    size = keys.groupBy("__part").agg(F.count("*").alias("__n"))
    start = size.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__start"))  # a row a range
    inside = F.row_number().over(Window.partitionBy("__part").orderBy("__key")) - 1
    number = keys.withColumn("__in", inside).join(start, "__part").select("__key", (F.col("__start") + F.col("__in")).alias("__number"))
    return df.join(number, F.col(order).eqNullSafe(F.col("__key"))).select(*df.columns, F.col("__number").alias(name))


def existing(df: DataFrame, wanted: list[str], renames: dict[str, str]) -> DataFrame:
    """Renamed columns, and of the wanted ones those that exist, in order and once."""
    df = df.withColumnsRenamed(renames)
    return df.select(*[c for c in dict.fromkeys(wanted) if c in df.columns])


_ITEM = r"""(?:'[^'\\]*(?:\\.[^'\\]*)*'|"[^"\\]*(?:\\.[^"\\]*)*")"""


def list_literal(text: Column) -> Column:
    """A list written as a literal, its items in single or double quotes, with apostrophes inside as the other quote or a
    backslash allow them; null if it isn't one."""
    whole = text.rlike(f"(?s)^\\s*\\[\\s*(?:{_ITEM}\\s*(?:,\\s*{_ITEM}\\s*)*,?\\s*)?\\]\\s*$")
    items = F.regexp_extract_all(text, F.lit(f"(?s){_ITEM}"), F.lit(0))
    return F.when(whole, F.transform(items, lambda x: F.regexp_replace(F.substr(x, F.lit(2), F.length(x) - 2), "(?s)\\\\(.)", "$1")))


def adapted(rows: DataFrame) -> DataFrame:
    """Adds reject_reason: the first rule that a canonical event's row breaks, or null. Columns: id, entity, event_type, status, impact, sentiment."""
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    out_of = lambda c, lo, hi: F.col(c).isNull() | F.isnan(c) | ~F.col(c).between(lo, hi)
    reason = F.when(blank("id"), "missing id").when(blank("entity"), "missing entity").when(blank("event_type"), "missing type")
    reason = reason.when(F.col("status").startswith("unresolved"), "unresolved").when(out_of("impact", 1.0, 10.0), "impact out of range").when(out_of("sentiment", -1.0, 1.0), "sentiment out of range")
    return rows.withColumn("reject_reason", reason)


def filled(*parts: Column) -> Column:
    """The first part that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(p), F.lit("")) for p in parts])


def joined(*parts: Column) -> Column:
    """The parts that are not blank, with a space between."""
    return F.concat_ws(" ", *[F.nullif(F.trim(p), F.lit("")) for p in parts])


def first_of_each(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first in order; as an aggregate it combines before it shuffles."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*key, "__r.*")


def bucket(key: Column, seed: int, buckets: int = 10_000) -> Column:
    """A repeatable bucket of a key, the same in every engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("long") % buckets


def split_name(key: Column, seed: int = 42) -> Column:
    """train, val or test (70, 15, 15): a group never falls into two of them."""
    b = bucket(key, seed, 100)
    return F.when(b < 70, "train").when(b < 85, "val").otherwise("test")


def sampled(df: DataFrame, key: str, n: int, seed: int = 42, first: Column | None = None) -> DataFrame:
    """``n`` rows in the order of a seeded hash; rows that ``first`` marks come before all others."""
    order = [F.desc(F.coalesce(first, F.lit(False)))] if first is not None else []
    return df.orderBy(*order, F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def softmax_label(scores: dict[str, Column]) -> Column:
    """label and probability of the largest score; ties go to the first label."""
    names = list(scores)
    top = F.greatest(*scores.values())
    weights = [F.exp(scores[n] - top) for n in names]
    total = sum(weights[1:], weights[0])
    label = F.coalesce(*[F.when(scores[n] == top, n) for n in names])
    return F.struct(label.alias("label"), (F.lit(1.0) / total).alias("probability"))


def promoted(candidates: DataFrame, existing_rows: DataFrame) -> DataFrame:
    """What happens to each run that is put up for promotion. candidates: run_id, signal_id, status, shape; existing_rows: run_id, signal_id."""
    same = existing_rows.select("run_id", F.col("signal_id").alias("old_signal"))
    taken = existing_rows.select("signal_id", F.col("run_id").alias("other_run"))
    j = candidates.join(same, "run_id", "left").join(taken, "signal_id", "left")
    out = F.when(F.col("status") != "COMPLETED", "rejected: status").when(F.coalesce("shape", F.lit(0)) < 1, "rejected: shape")
    out = out.when(F.col("old_signal") == F.col("signal_id"), "unchanged").when(F.col("old_signal").isNotNull() | F.col("other_run").isNotNull(), "rejected: collision").otherwise("promoted")
    return j.select("run_id", "signal_id", out.alias("outcome"))


def recovered(runs: DataFrame) -> DataFrame:
    """Runs that an end of the process interrupted count as failed."""
    hung = F.col("status").isin("PENDING", "RUNNING")
    return runs.withColumn("error", F.when(hung, "interrupted").otherwise(F.col("error"))).withColumn("status", F.when(hung, "FAILED").otherwise(F.col("status")))


def around(events: DataFrame, bars: DataFrame, key: str, at: str, ts: str, value: str) -> DataFrame:
    """For each event the observation it falls on, the last value up to its time, and the first value an hour after that
    observation or later, however far away either is; an event before all values has neither.

    bars has one value a key and time.  Each value first gets the one that follows it by an hour, then events take both
    from the last value: two running lookups, cut by days (``running_last``)."""
    point = F.struct(F.col("t").alias("t"), F.col("v").alias("v"))
    values = bars.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("t"), F.col(value).alias("v"))
    # Backwards in time: a value asks for the last one seen at an hour later or more, which is the first there.
    ahead = values.select("key", (-F.unix_micros("t")).alias("us"), F.lit(0).alias("kind"), point.alias("seen"), F.lit(None).cast("timestamp").alias("of"))
    asks = values.select("key", (-F.unix_micros(F.col("t") + F.expr("interval 1 hour"))).alias("us"), F.lit(1).alias("kind"), F.lit(None).cast(ahead.schema["seen"].dataType).alias("seen"), F.col("t").alias("of"))
    later = running_last(ahead.unionByName(asks), ["key"], "us", ["kind"], "seen", "after").filter("kind = 1").select("key", F.col("of").alias("t"), F.col("after.v").alias("later"))
    both = values.join(later, ["key", "t"]).select("key", F.unix_micros("t").alias("us"), F.lit(0).alias("kind"), F.struct("v", "later").alias("seen"), F.lit(None).cast("long").alias("event_id"))
    asked = events.select(F.col(key).alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("us"), F.lit(1).alias("kind"), F.lit(None).cast(both.schema["seen"].dataType).alias("seen"), F.col("event_id").cast("long").alias("event_id"))
    found = running_last(both.unionByName(asked), ["key"], "us", ["kind"], "seen", "on").filter("kind = 1")
    return found.select(F.col("key").alias(key), "event_id", F.col("on.v").alias("before"), F.col("on.later").alias("after"))


def safe_name(label: str, prefix: str = "") -> str:
    """A column name for a label: upper case, its separators as one underscore."""
    return prefix + label.upper().replace(" & ", "_").replace(" / ", "_").replace(" ", "_")


def with_safe_names(df: DataFrame, labels: list[str], prefix: str = "") -> DataFrame:
    """The columns named by labels under safe names; two labels with one name are an error."""
    new = {label: safe_name(label, prefix) for label in labels if label in df.columns}
    after = [new.get(c, c) for c in df.columns]
    if len(set(after)) < len(after):
        raise ValueError(f"names fall together: {sorted({c for c in after if after.count(c) > 1})}")
    return df.withColumnsRenamed(new)


def percent_text(part: Column, whole: Column, places: int = 1) -> Column:
    """A share as text such as 12.5%; 0% of nothing."""
    return F.concat(F.format_string(f"%.{places}f", F.coalesce(F.try_divide(part.cast("double") * 100, whole.cast("double")), F.lit(0.0))), F.lit("%"))


def strongest(rows: DataFrame, types: list[str], entities: list[str] | None = None) -> DataFrame:
    """The valid, material event of the given types (and entities) with the largest impact, the earliest of equals, then
    the smallest id; one row, and an error when read if there is none.

    rows: event_id, entity, entity_status, materiality, impact_score, event_type, timestamp."""
    fit = rows.filter((F.col("entity_status") == "valid") & (F.col("materiality") == "MATERIAL_EVENT") & (F.col("impact_score") >= 1.0) & F.col("event_type").isin(types))
    if entities is not None:
        fit = fit.filter(F.col("entity").isin(entities))
    best = fit.agg(F.min_by(F.struct(*rows.columns), F.struct(-F.col("impact_score"), F.col("timestamp"), F.col("event_id"))).alias("b"))
    none = F.raise_error(F.lit("no event fits")).cast(best.schema["b"].dataType)
    return best.select(F.coalesce("b", none).alias("b")).select("b.*")


def observations(rows: DataFrame, extra: dict[str, Column], company: Column) -> DataFrame:
    """Simulation requests as observations: headline and body in one text, request-wide metadata over the row's own, and
    the company in place of the row's entity where it is given.  reject_reason is there for rows without any text.

    rows: headline, body, entity, metadata (map of strings).  Of the extra entries blank ones don't count."""
    given = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in extra.items()]), lambda e: F.coalesce(e["value"], F.lit("")) != ""))
    own = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(own, lambda k, v: ~F.array_contains(F.map_keys(given), k)), given)
    kept = F.when(F.size(given) > 0, merged).otherwise(F.col("metadata"))
    text = joined(F.col("headline"), F.col("body"))
    return rows.withColumn("text", text).withColumn("metadata", kept).withColumn("entity", F.coalesce(F.nullif(company, F.lit("")), F.col("entity"))).withColumn("reject_reason", F.when(text == "", "no text"))


def audit_rows(rows: DataFrame, text: str, row_id: str, number: str, materiality: str) -> DataFrame:
    """Adds what an audit shows: the row's id or else its number, the text's hash, and a label where materiality is missing."""
    gone = lambda c: F.col(c).isNull() | F.lower(F.col(c).cast("string")).isin("nan", "")
    return rows.withColumn("text_hash", F.md5(F.coalesce(F.col(text), F.lit("")))).withColumn(row_id, F.when(gone(row_id), F.col(number).cast("string")).otherwise(F.col(row_id).cast("string"))).withColumn(materiality, F.when(gone(materiality), "NON_MATERIAL").otherwise(F.col(materiality)))
