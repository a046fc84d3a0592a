"""Sharding by sampled splitters, for groups of equal texts.

A hash of the text orders the groups.  A size-weighted sample of the keys gives the splitters of narrow
ranges; overfull ranges are subdivided by a second hash, each piece is counted exactly, and prefix sums over
the pieces place every group in the whole order.  Shards are intervals of that order, cut between groups.

A group of more than a sixteenth of a shard would make the cuts uneven.  There are at most 16 times as many
of them as shards: the largest goes first, each to the shard with the fewest bytes, and the intervals fill up
what they leave.  No group is cut: one larger than a shard has a shard of its own, and the others share the rest.

Defined cases: a null text has size 1 like an empty one and is of its group; null ids hash like any value;
repeated rows are told apart by number only and get neighbouring slots; ties between keys are ordered by the
second hash; a very long text is one row of its size; an empty table gives an empty result; columns other
than id and text, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_key, unsigned, written

RANGES = 512
SAMPLE = 16_384
#: Groups in a piece of a range, on average; parts of a group that are numbered by different tasks.
PIECE, PARTS = 100_000, 1024
HEAVY = 16


def _splitters(groups: DataFrame, total: int, ranges: int, sample: int) -> list[int]:
    """At most ``ranges - 1`` keys at the quantiles of a size-weighted sample of about ``sample`` keys."""
    rate = sample / max(total, 1)
    drawn = groups.filter(unsigned(F.xxhash64("k", "k2", F.lit(11))) < F.col("w") * rate)
    q = [i / ranges for i in range(1, ranges)]
    row = drawn.agg(F.percentile_approx("k", q, 10_000).alias("q")).first()
    return sorted(set(row.q or []))


def _ranged(groups: DataFrame, cuts: list[int]) -> DataFrame:
    """Adds r, the range of the key. It is found in two steps among the splitters: a stride, then inside it."""
    stride = 24
    heads = cuts[stride - 1 :: stride]
    block = F.size(F.filter(F.lit(heads).cast("array<bigint>"), lambda c: c <= F.col("k")))
    blocks = [cuts[i : i + stride] for i in range(0, len(cuts), stride)] or [[]]
    inner = F.coalesce(F.get(F.lit(blocks).cast("array<array<bigint>>"), F.col("b")), F.array().cast("array<bigint>"))
    return groups.withColumn("b", block).withColumn("r", F.col("b") * stride + F.size(F.filter(inner, lambda c: c <= F.col("k"))))


def _before(column: str, window) -> F.Column:
    return F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", ranges: int = RANGES, sample: int = SAMPLE, per_piece: int = PIECE) -> DataFrame:
    """One row a record: id, size, text_crc32, law ``bytes``, shard, slot, grown_shard (always null)."""
    spark, text = docs.sparkSession, F.col(text_col)
    keyed = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        text_key(text)["a"].alias("k"), text_key(text)["b"].alias("k2"),
        F.pmod(F.xxhash64(F.lit(3), F.col(id_col)), F.lit(PARTS)).cast("int").alias("q"),
    )
    keyed = written(keyed, "shard-keys")
    parts = written(keyed.groupBy("k", "k2", "q").agg(F.sum("size").alias("w"), F.count("*").alias("n")), "shard-parts")
    total = int(parts.agg(F.sum("w")).first()[0] or 0)
    fair = max(total, 1) / shards

    big = parts.groupBy("k", "k2").agg(F.sum("w").alias("w"), F.sum("n").alias("n")).filter(F.col("w") > fair / HEAVY).collect()  # at most HEAVY * shards rows
    loads, counts, placed = [0] * shards, [0] * shards, []
    for g in sorted(big, key=lambda g: (-g.w, g.k, g.k2)):
        s = min(range(shards), key=lambda i: (loads[i], i))
        placed.append((g.k, g.k2, s, counts[s]))
        loads[s], counts[s] = loads[s] + g.w, counts[s] + g.n
    heavy = spark.createDataFrame(placed, "k bigint, k2 bigint, shard int, ahead bigint")

    flow = parts.join(F.broadcast(heavy), ["k", "k2"], "left_anti").groupBy("k", "k2").agg(F.sum("w").alias("w"), F.sum("n").alias("n"))
    flow = _ranged(flow, _splitters(flow, total, ranges, sample))
    pieces = flow.groupBy("r").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / per_piece)).cast("int").alias("pieces"))
    flow = flow.join(F.broadcast(pieces), "r").withColumn("p", F.floor(unsigned(F.col("k2")) * F.col("pieces")).cast("int"))
    piece = flow.groupBy("r", "p").agg(F.sum("w").alias("w"), F.sum("n").alias("n"))
    each = piece.groupBy("r").agg(F.sum("w").alias("w"), F.sum("n").alias("n"))
    line, within = Window.orderBy("r"), Window.partitionBy("r").orderBy("p")  # RANGES rows; then the pieces of a range
    each = each.select("r", _before("w", line).alias("rw"), _before("n", line).alias("rn"))
    start = piece.select("r", "p", _before("w", within).alias("pw"), _before("n", within).alias("pn")).join(F.broadcast(each), "r")
    inside = Window.partitionBy("r", "p").orderBy(F.shiftrightunsigned("k2", 11), "k2", "k")
    place = flow.join(start, ["r", "p"]).withColumn("w0", F.col("rw") + F.col("pw") + _before("w", inside)).withColumn("n0", F.col("rn") + F.col("pn") + _before("n", inside))

    # Each shard takes what its heavy groups leave; a group goes where its middle lies.
    room = [max(fair - w, 0.0) for w in loads]
    scale = (total - sum(loads)) / max(sum(room), 1e-9)
    ends = [sum(room[: i + 1]) * scale for i in range(shards - 1)]
    middle = F.col("w0") + F.col("w") / 2
    place = place.withColumn("shard", F.size(F.filter(F.lit(ends).cast("array<double>"), lambda e: e <= middle)))
    place = written(place.select("k", "k2", "shard", "n0", "n"), "shard-order")
    first = place.groupBy("shard").agg(F.min("n0").alias("first"), F.sum("n").alias("flowing"))
    place = place.join(F.broadcast(first), "shard").select("k", "k2", "shard", (F.col("n0") - F.col("first")).alias("s0"))
    fixed = heavy.join(F.broadcast(first), "shard", "left").select("k", "k2", "shard", (F.col("ahead") + F.coalesce("flowing", F.lit(0))).alias("s0"))

    of_group = Window.partitionBy("k", "k2").orderBy("q")  # PARTS rows at most
    slots = parts.select("k", "k2", "q", _before("n", of_group).alias("n0")).join(place.unionByName(fixed), ["k", "k2"]).select("k", "k2", "q", "shard", (F.col("s0") + F.col("n0")).alias("s0"))
    number = F.row_number().over(Window.partitionBy("k", "k2", "q").orderBy("doc_id", "text_crc32", "size"))
    return keyed.join(slots, ["k", "k2", "q"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("s0") + number - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
