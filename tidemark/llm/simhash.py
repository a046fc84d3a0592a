"""Near-duplicates by SimHash fingerprints, found with multi-index hashing.

A fingerprint's bit is the majority of that bit over the hashes of all word shingles of a text, repeats included.
Fingerprints are linked if they differ in ``RADIUS`` = 3 bits or fewer.  Two such ones differ in one bit or none in
their upper or in their lower half, so:

1. Equal fingerprints become one node.  Each half has a table of nodes by its 32 bits.  A node stands there under its
   own value, and looks up the small Hamming ball around it: all values that lack one of its set bits.  That reaches
   each pair at a distance of one from the side that has the bit.
2. What meets under one value is compared in full, and links that join what isn't joined yet come out: at most one
   less than there are nodes, however dense the region.
3. A value with more than ``CROWD`` nodes, or one bit away from such, is crowded.  Its nodes go to a second index over
   the 32 bits that are still open, again by halves and balls, so that what meets there shares 48 bits but for two and
   no more than 2**16 fingerprints can be equal in them; the rest stays as above.
4. Links give components, and each component its smallest id.

Nothing is capped: each pair of different fingerprints at 3 bits or fewer meets under some value of the first or the
second index.  Shuffled are some 34 rows of 17 bytes a distinct fingerprint.

Defined cases: null and empty texts, and those of white space only, have fingerprint 0 and are linked like any other;
a text of fewer words than a shingle is one shingle; a bit set in exactly half of the hashes is 0; equal rows have
equal fingerprints and all stay; a null id is the smallest only if there is no other; a very long text is held whole
by one task (some 100 bytes a word); an empty table gives an empty result; other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FOLD, discard, small_batches, utf8, written
from .minhash import components

RADIUS = 3
#: Nodes under one value of a half from which on the second index is used. A bucket of the first then has at most 33 times as many.
CROWD = 256


def fingerprint(text: bytes, size: int = 3) -> int:
    words = text.translate(FOLD).split()
    if not words:
        return 0
    length = np.fromiter(map(len, words), np.int64, len(words))
    line = b" ".join(words)
    ends = np.cumsum(length + 1) - 1
    starts, ends = (ends - length)[: max(len(words) - size + 1, 1)], ends[min(size, len(words)) - 1 :]
    n = len(starts)
    h = np.fromiter((xxhash.xxh64_intdigest(line[s:e], 42) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), np.dtype("<u8"), n)
    votes = sum(np.unpackbits(h[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for k in range(0, n, 8192))
    return int.from_bytes(np.packbits(2 * votes > n, bitorder="little").tobytes(), "little")


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(text, size) for text in utf8(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fp.view(np.int64))], ["id", "fp"])

    return run


def ball(value: Column, width: int) -> Column:
    """The value, and those that lack one of its bits."""
    bits = F.array(*[F.lit(1 << k).cast("bigint") for k in range(width)])
    return F.concat(F.array(value), F.transform(F.filter(bits, lambda b: value.bitwiseAND(b) != 0), lambda b: value - b))


def looked_up(rows: DataFrame, part: Column, width: int, key: str, keep: list[str], own: str) -> DataFrame:
    """A row for each of both segments of ``part`` (2 * width bits) and each value in the ball around it: ``key``
    names segment and value, ``own`` tells whether it is the value itself."""
    low = part.bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))
    high = F.shiftrightunsigned(part, width).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))
    two = F.array(F.struct(F.lit(0).alias("s"), high.alias("v")), F.struct(F.lit(1).alias("s"), low.alias("v")))
    each = rows.select(*keep, F.explode(two).alias("t"))
    each = each.select(*keep, "t", F.explode(ball(F.col("t.v"), width)).alias("x"))
    return each.select(*keep, (F.col("t.s") * F.lit(1 << width).cast("bigint") + F.col("x")).alias(key), (F.col("x") == F.col("t.v")).alias(own))


def connect(fp: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Pairs at ``radius`` bits or fewer that join all that such pairs join."""
    comp, out = np.arange(len(fp)), []
    for i in range(len(fp)):
        other = np.flatnonzero(comp != comp[i])
        if not len(other):
            break
        for j in other[np.bitwise_count(fp[other] ^ fp[i]) <= radius].tolist():
            if comp[j] != comp[i]:
                out.append((i, j))
                comp[comp == comp[j]] = comp[i]
    return out


def _met(keys: list[str], flags: list[str], radius: int):
    """Rows come sorted by the keys: the links inside each bucket that has, for each flag, a row that carries it."""

    def links(rows: list[np.ndarray]) -> pa.RecordBatch:
        *key, fp = rows[: len(keys) + 1]
        u, v = [], []
        if len(fp) > 1:
            new = np.flatnonzero(np.concatenate(([True], np.any([k[1:] != k[:-1] for k in key], axis=0))))
            n = np.diff(np.append(new, len(fp)))
            useful = (n > 1) & np.all([np.logical_or.reduceat(f, new) for f in rows[len(keys) + 1 :]], axis=0)
            for lo, size in zip(new[useful].tolist(), n[useful].tolist(), strict=True):
                for i, j in connect(fp[lo : lo + size], radius):
                    u.append(fp[lo + i])
                    v.append(fp[lo + j])
        u, v = np.array(u, np.uint64).view(np.int64), np.array(v, np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in keys] + [batch.column("fp").to_numpy().view(np.uint64)] + [batch.column(c).to_numpy(zero_copy_only=False) for c in flags]
            rows = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            last = np.all([k == k[-1] for k in rows[: len(keys)]], axis=0)
            cut = len(last) - int(last.sum())  # the last bucket may go on
            if cut:
                yield links([x[:cut] for x in rows])
            held = [x[cut:] for x in rows]
        if held is not None:
            yield links(held)

    return run


def near_links(nodes: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """nodes: fp, distinct. Links (u, v) that join all fingerprints at ``radius`` (3 at most) bits or fewer."""
    meet = lambda rows, keys, flags: rows.select(*keys, "fp", *flags).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_met(keys, flags, radius), "u bigint, v bigint")
    first = looked_up(nodes, F.col("fp"), 32, "key", ["fp"], "own")
    # Crowded values and those one bit below, from the sizes of the tables: two numbers a node.
    half = F.pmod("key", F.lit(1 << 32))
    full = first.filter("own").groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > crowd)
    full = written(full.select(F.explode(F.transform(ball(half, 32), lambda x: F.col("key") - half + x)).alias("key")).distinct(), "crowded")
    if full.isEmpty():
        discard(full)
        return written(meet(first, ["key"], ["own"]).distinct(), "links")
    plain = meet(first.join(full, "key", "left_anti"), ["key"], ["own"])
    rest = F.when(F.col("key") < 1 << 32, F.col("fp")).otherwise(F.shiftrightunsigned("fp", 32)).bitwiseAND(F.lit((1 << 32) - 1).cast("bigint"))
    second = looked_up(first.join(full, "key", "left_semi"), rest, 16, "sub", ["fp", "key", "own"], "own2")
    out = written(plain.union(meet(second, ["key", "sub"], ["own", "own2"])).distinct(), "links")
    discard(full)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """One row a record: id, fingerprint (16 hexadecimal digits), component_id (the smallest id that links reach)."""
    if not 0 <= radius <= 3:
        raise ValueError("the index finds pairs at 0 to 3 bits")
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_fingerprints(size), f"id {kind}, fp bigint")
    described = written(rows, "fingerprints")
    nodes = described.groupBy("fp").agg(F.min("id").alias("least"))
    links = near_links(nodes.select("fp"), radius, crowd)
    label = components(links).withColumnRenamed("node", "fp")
    named = nodes.join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    smallest = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "label").select("fp", "component_id")
    out = described.join(named, "fp")
    return out.select("id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
