"""Ingest: candidate funnel, deduplication, entity resolution, validation."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.lexicon import DOMAINS, PUBLISHERS, THEMES
from tidemark.functions.text import entity_key
from tidemark.sources.scratch import stored


def any_substring(text: Column, words: list[str]) -> Column:
    """Substring hits, as the filter means it: "sec" also hits "second".

    A search for each word costs a third of an alternation, which is tried at every place; ``exists`` binds the text, so
    that what it is made from is computed once and not for each word."""
    return F.exists(F.array(text), lambda t: reduce(or_, [F.contains(t, F.lit(w)) for w in words], F.lit(False)))


def domain_signal(domain: Column, publisher: Column | None = None, trusted: list[str] = DOMAINS) -> Column:
    """The domain, or the publisher where there is none, is a trusted one or below it; blanks and case don't count."""
    clean = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    name = clean(domain) if publisher is None else F.coalesce(clean(domain), clean(publisher))
    hit = F.lit(False)
    for t in trusted:
        hit = hit | (name == t) | name.endswith("." + t)
    return F.coalesce(hit, F.lit(False))


#: The keys under which raw records may hold their themes, in the order of precedence.
THEME_KEYS = ["themes", "V2Themes", "THEMES", "Themes"]


def theme_signal(themes: Column, prefixes: list[str] = THEMES) -> Column:
    """Any theme begins with a prefix, in any case. Themes are a list, or one string with semicolons."""
    return F.exists(F.coalesce(_theme_list(themes), F.array().cast("array<string>")), lambda t: t.rlike("^(" + "|".join(prefixes) + ")"))


def _theme_list(themes: Column) -> Column:
    each = lambda items: F.transform(items, lambda t: F.upper(F.trim(t)))
    text = F.trim(themes.cast("string"))
    return F.when(text.startswith("["), each(F.from_json(text, "array<string>"))).otherwise(each(F.split(text, ";")))


def raw_theme_signal(metadata: Column, prefixes: list[str] = THEMES) -> Column:
    """The same for raw records (JSON text): the first of the known keys that is there has the themes."""
    found = F.coalesce(*[F.get_json_object(metadata, f"$.{k}") for k in THEME_KEYS])
    return theme_signal(found, prefixes)


def candidate_filter(docs: DataFrame, signals: dict[str, Column], score: Column | None = None, threshold: float = 0.3) -> DataFrame:
    """All rows, with the reasons that hold (in the signals' order) and ``kept`` where there is any.

    With a ``score``, rows without a reason are kept as SEMANTIC from the threshold on; others are not asked for it."""
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in signals.items()]))
    rows = docs.withColumn("reasons", reasons)  # by name from here on: the signals are evaluated once
    if score is not None:
        rows = rows.withColumn("reasons", F.when((F.size("reasons") == 0) & (score >= threshold), F.array(F.lit("SEMANTIC"))).otherwise(F.col("reasons")))
    return rows.withColumn("kept", F.size("reasons") > 0)


def first_seen(docs: DataFrame, keys: list[Column], seq: str) -> DataFrame:
    """The rows, in the order of ``seq`` (unique), that share none of their keys with a row kept before.

    A row that is dropped registers none of its keys.  In each round the rows that come first among the
    undecided ones for all of their keys are kept, and what shares a key with them is dropped; every round
    decides at least the first row of each key's group, and few chains need more than two or three."""
    named = F.array(*[F.concat(F.lit(f"{k}:"), F.coalesce(c.cast("string"), F.lit("None"))) for k, c in enumerate(keys)])
    kept = first_come(docs.select(F.col(seq).alias("seq"), F.explode(named).alias("key")))
    return docs.join(kept.withColumnRenamed("seq", seq), seq, "left_semi")


def first_come(keys: DataFrame) -> DataFrame:
    """keys: seq, key, in any number a seq.  The seqs that share no key with a smaller one that is kept."""
    open_rows, kept = stored(keys), keys.select("seq").limit(0)
    while not open_rows.isEmpty():
        low = open_rows.groupBy("key").agg(F.min("seq").alias("low"))
        winners = open_rows.join(low, "key").groupBy("seq").agg(F.bool_and(F.col("seq") == F.col("low")).alias("first")).filter("first").select("seq")
        winners = stored(winners)
        kept = kept.union(winners)
        taken = open_rows.join(winners, "seq", "left_semi").select("key").distinct()
        gone = open_rows.join(taken, "key", "left_semi").select("seq").distinct()
        open_rows = stored(open_rows.join(gone, "seq", "left_anti"))
    return kept


def resolve(names: DataFrame, name: str, aliases: DataFrame, publishers: list[str] = PUBLISHERS) -> DataFrame:
    """The rows with entity_id, canonical, status and confidence of their name. aliases: alias, entity_id, canonical.

    A publisher is a source and no entity; then comes the alias in any case (1.0), then the name without company suffix
    and punctuation (0.85).  Other names stand for themselves, so equal ones still fall together; empty ones and sources
    have no canonical name.  An alias of several entities means the one with the smallest id."""
    known = aliases.groupBy(F.lower("alias").alias("key")).agg(F.min(F.struct("entity_id", "canonical")).alias("hit"))
    said = F.trim(F.coalesce(F.col(name), F.lit("")))
    rows = names.select(F.struct("*").alias("row"), said.alias("said"), F.lower(said).alias("low"), F.nullif(entity_key(said), F.lit("")).alias("bare"))
    rows = rows.join(known.select(F.col("key").alias("low"), F.col("hit").alias("exact")), "low", "left")
    rows = rows.join(known.select(F.col("key").alias("bare"), F.col("hit").alias("near")), "bare", "left")
    source, empty = F.col("low").isin(publishers), F.col("said") == ""
    hit = F.when(~source & ~empty, F.coalesce("exact", "near"))
    status = F.when(source, "unresolved_source").when(hit.isNotNull(), "valid").otherwise("unresolved_entity")
    canonical = F.when(source | empty, "").otherwise(F.coalesce(F.nullif(hit["canonical"], F.lit("")), "said"))
    confidence = F.when(hit.isNull(), 0.0).when(F.col("exact").isNotNull(), 1.0).otherwise(0.85)
    return rows.select("row.*", hit["entity_id"].alias("entity_id"), canonical.alias("canonical"), status.alias("status"), confidence.alias("confidence"))


def alias_scan(docs: DataFrame, id_col: str, text: Column, aliases: DataFrame, longest: int) -> DataFrame:
    """Aliases contained in a text as whole words, by an equi-join on its word n-grams. aliases: alias, entity_id."""
    words = F.split(text, " ")
    none = F.array().cast("array<string>")

    def of_length(n: int) -> Column:
        return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(none)

    grams = F.concat(*[of_length(n) for n in range(1, longest + 1)])
    hits = docs.select(id_col, F.explode(F.array_distinct(grams)).alias("alias")).join(aliases, "alias")
    return hits.groupBy(id_col).agg(F.array_join(F.array_sort(F.collect_set("entity_id")), ",").alias("entities"))


def names_any(text: Column, aliases: list[str]) -> Column:
    """Whether one of a few aliases is contained in the text as whole words: what ``alias_scan`` finds, without its
    n-grams, which take a row for every word and more memory than the text."""
    return any_substring(F.concat(F.lit(" "), text, F.lit(" ")), [f" {a} " for a in aliases])


def row_identity(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: ids missing on the right, extra there, and duplicate ids on either side."""
    a, b = left.groupBy(key).agg(F.count("*").alias("na")), right.groupBy(key).agg(F.count("*").alias("nb"))
    j = a.join(b, key, "full")
    n = lambda cond, name: F.count(F.when(F.expr(cond), 1)).alias(name)
    return j.agg(n("nb is null", "missing"), n("na is null", "extra"), n("na > 1", "duplicate_left"), n("nb > 1", "duplicate_right"))
