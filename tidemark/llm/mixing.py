"""Mixing sources to target weights with a time-varying curriculum.

Each source asks for ``target`` words over the whole run.  Its demand is not level: a linear rate runs
from ``start`` to ``end`` (relative to its mean), and the integral of the rate is the cumulative demand.
Documents stand in a repeatable order inside their source; the word interval that a document covers in
that order is looked up in the inverse of the cumulative demand, which gives its training position in
[0, 1].  Sorting by position (a range sort) mixes the sources as the schedules say.

A source that asks for more than it has is read again: whole passes first, then the part of one more
pass that is left.  ``cut`` decides about the document at the end of that part: ``split`` takes the
words that are still asked for, ``whole`` takes the document if at least half of it is.

Defined cases: null or empty texts have size 0 and take 0; a null source is a source of its own, last in
order; equal rows stand side by side and count one by one; ties in a source's order (a hash) go to the smaller
id, and documents with one training position come in any order; a very long text is one row of its size; an
empty table gives an empty result; further columns, whatever their names, are kept by ``mix`` and ignored by ``plan``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import word_count, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Start and end rate for each weight in the list: heavy sources lead, light ones close.
RAMPS = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
BUCKET = 3  # hex digits: 4096 buckets in each source


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``sizes``: one row a source (source, source_size).  Adds weight, target, start and end.

    The excess of capped sources is shared out again by weight, until none is above.  Sources are capped
    in the order of capacity per weight, so the end of that process is found by two running sums.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = lambda values: F.get(F.lit(values), (rank % len(values)).cast("int"))
    s = sizes.withColumn("weight", pick([float(w) for w in weights])).withColumn("start", pick([a for a, _ in RAMPS])).withColumn("end", pick([b for _, b in RAMPS]))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(everything) * F.lit(share) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    heavy = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("level", left / heavy)
    s = s.withColumn("capped", F.col("level") * F.col("weight") >= most * F.col("source_size"))
    level = F.min(F.when(~F.col("capped"), F.struct(F.col("source_size") / F.col("weight"), F.col("level"))))
    s = s.withColumn("final", level.over(everything)["level"])
    return s.select("source", "source_size", "weight", "start", "end", F.when(F.col("capped"), (most * F.col("source_size")).cast("double")).otherwise(F.col("final") * F.col("weight")).alias("target"))


def _position(x, start, end):
    """Invert the integral of a linear rate: the t in [0, 1] at which the share x of the demand is met."""
    a, b = 2 * start / (start + end), 2 * end / (start + end)
    slope = b - a
    return F.when(F.abs(slope) < 1e-12, x).otherwise((F.sqrt(F.greatest(a * a + 2 * slope * x, F.lit(0.0))) - a) / slope)


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cut: str = "split") -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, passes, part, taken, positions (one for each
    time it is read, smallest first), and ``h`` and ``x``, the names by which ``mix`` finds it again."""
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("x"),
    ).withColumn("h", F.md5(F.concat_ws(" ", F.col("doc_id").cast("string"), "x"))).withColumn("b", F.substring("h", 1, BUCKET))
    sized = written(sized, "mix-sizes")
    bucket = sized.groupBy("source", "b").agg(F.sum("size").alias("w"))
    source = targets(bucket.groupBy("source").agg(F.sum("w").alias("source_size")))
    ahead = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    begin = bucket.select("source", "b", F.coalesce(F.sum("w").over(ahead), F.lit(0)).alias("w0"))
    begin = begin.join(source, begin["source"].eqNullSafe(source["source"])).drop(source["source"])
    inside = Window.partitionBy("source", "b").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    run = sized.withColumn("c", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    run = run.join(begin, run["source"].eqNullSafe(begin["source"]) & (run["b"] == begin["b"])).drop(begin["source"], begin["b"])
    run = run.withColumn("c", F.col("w0") + F.col("c"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    run = run.withColumn("passes", whole).withColumn("left", F.col("target") - F.col("passes") * F.col("source_size"))
    if cut == "split":
        part = F.greatest(F.least(F.round("left").cast("long") - F.col("c"), F.col("size")), F.lit(0))
    else:
        part = F.when(F.col("c") + F.col("size") / 2 <= F.col("left"), F.col("size")).otherwise(0)
    run = run.withColumn("part", part.cast("long")).withColumn("taken", (F.col("passes") * F.col("size") + F.col("part")).cast("long"))
    # Documents without words are read as often as a pass reads them.
    times = (F.col("passes") + F.when(F.col("part") > 0, 1).otherwise(0)).cast("int")
    middle = lambda e: F.coalesce(F.least((e * F.col("source_size") + F.col("c") + F.col("size") / 2) / F.nullif(F.col("target"), F.lit(0.0)), F.lit(1.0)), F.lit(1.0))
    reads = F.transform(F.sequence(F.lit(0), times - 1), lambda e: _position(middle(e), F.col("start"), F.col("end")))
    return run.withColumn("positions", F.when(times > 0, reads).otherwise(F.array().cast("array<double>")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is read, range-sorted by training position.

    Equal rows (id, source and text) are each taken as often as the first of them."""
    chosen = plan(docs, id_col, text_col, source_col, cut="whole").filter(F.size("positions") > 0)
    chosen = chosen.groupBy(F.col("doc_id").alias("i"), F.col("source").alias("s"), "x").agg(F.min_by("positions", "c").alias("positions"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("y"))
    rows = rows.join(chosen, rows["id"].eqNullSafe(chosen["i"]) & rows["source"].eqNullSafe(chosen["s"]) & (rows["y"] == chosen["x"]))
    return rows.select("row", F.explode("positions").alias("t")).orderBy("t").select("row.*")
