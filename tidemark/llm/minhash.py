"""Near-duplicate detection with an LSH forest.

Texts with equal shingle sets become one node.  A node has a sketch of 128 minhash values and stands in 32
sorted orders, each of which begins with four values of its own and goes on with the next ones.

1. Orders.  Nodes that agree on the first values of an order form a region of it; nodes alone in all of
   their regions leave.  In a region neighbours in the order, those with the longest common prefix, are
   candidates if enough of their sketches agree; where neighbours do not connect a region, its nodes are
   compared further, as far as the region is dense: a window of the sorted order at a time.  Orders are cut into
   ranges of like size, so a region of any size is many tasks' work; the rows on both sides of each cut are looked
   at once more.
2. Groups.  Candidates join nodes to groups, so that texts that could be linked lie in one group.
3. Exact.  Only texts of groups travel, one of each set; a set is compared with the others of its group in blocks inside a task; a
   pair that is already connected is not looked at again, so only links that join components come out.  A
   group of many blocks is joined by one representative of each component in ever wider rounds; what is
   not in its largest component then meets every block of it, so no pair is left out.

A link is missed only if no order puts its texts in one window: with 32 orders of four values the chance is
5e-8 for a pair at 80 % and less for closer ones; in a region denser than a window, nodes further apart in
its order meet in other orders or through the nodes between them.

Defined cases: null and empty texts have no set and stay alone; a text of fewer words than a shingle is
one shingle; equal rows fall into one component and carry the same id; ties between ids don't arise, the
smallest id is the component's; a null id is never the smallest unless it is the only one; a very long
text is one set in memory (8 bytes a word); an empty table gives an empty result; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import FOLD, HASHES, bitmap, discard, in_bitmap, mixed, small_batches, text_key, utf8, written

VALUES, BAND = 128, 4
TREES = VALUES // BAND
#: Places of a sorted order that are looked at together, and those carried on to the next look.
PLACES, CARRIED = 2048, 128
#: Shingles in a block of sets that one task compares (8 bytes each).
BLOCK = 500_000
_rng = np.random.default_rng(20)
_XOR, _MUL = _rng.integers(0, 1 << 32, VALUES, dtype=np.uint32), _rng.integers(0, 1 << 31, VALUES, dtype=np.uint32) * 2 + 1
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, size: int) -> np.ndarray:
    """The sorted distinct hashes of the word shingles of a text."""
    words = text.translate(FOLD).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = HASHES.of(words)
    size = min(size, len(words))
    out = np.full(len(words) - size + 1, len(words) if len(words) < size else size, np.uint64)
    for k in range(size):
        out = mixed(out * _STEP + h[k : len(words) - size + 1 + k])
    return np.unique(out)


def sketch(s: np.ndarray) -> np.ndarray:
    low = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 512):
        np.minimum(least, ((low[at : at + 512, None] ^ _XOR) * _MUL).min(axis=0), out=least)
    return (least ^ (least >> 16)).astype(np.uint16)


def _nodes(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node, sk = [], [], []
            for text in utf8(batch.column("text")):
                s = shingles(text, size)
                n.append(len(s))
                node.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sk.append(sketch(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("ka"), batch.column("kb"), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(sk, pa.binary())], ["id", "ka", "kb", "n", "node", "sk"])

    return run


def _matrix(column: pa.Array, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _head(node: pa.Array) -> np.ndarray:
    """A node's short name in the orders. Where two nodes share it they are candidates, no more."""
    return _matrix(node, ">i8")[:, 0].astype(np.int64)


def _short(node: str):
    """The same as a column: the first eight bytes."""
    return F.conv(F.hex(F.substring(node, 1, 8)), 16, -10).cast("long")


def _first_values(sk: np.ndarray) -> np.ndarray:
    return mixed(np.ascontiguousarray(sk).view(np.uint64).reshape(len(sk), TREES) + np.arange(1, TREES + 1, dtype=np.uint64) * _STEP)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key = _first_values(_matrix(batch.column("sk"), np.uint16))
        yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(np.repeat(_head(batch.column("node")), TREES))], ["key", "h"])


def _crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key: the nodes that share one with the row before or behind, and those at the ends, whose
    neighbours are in other ranges."""
    key, h, first = np.zeros(0, np.int64), np.zeros(0, np.int64), True
    for batch in batches:
        if not batch.num_rows:
            continue
        key, h = (np.concatenate((old, batch.column(c).to_numpy())) for old, c in ((key, "key"), (h, "h")))
        same = key[1:] == key[:-1]
        hit = np.concatenate((same, [False])) | np.concatenate(([first], same))
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(h[hit]))], ["h"])
        key, h, first = key[-1:], h[-1:], False
    yield pa.RecordBatch.from_arrays([pa.array(h)], ["h"])


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A node's place in each order: the region, the values that follow, and its sketch in eight bits a value."""
    for batch in batches:
        sk = _matrix(batch.column("sk"), np.uint16)
        quad = sk.reshape(len(sk), TREES, BAND).astype(np.uint64)
        deep = sum(quad[:, :, k] << np.uint64(16 * (BAND - 1 - k)) for k in range(BAND))
        flat = lambda x: pa.array(np.ascontiguousarray(x).reshape(-1).view(np.int64))
        small = sk.astype(np.uint8)
        yield pa.RecordBatch.from_arrays(
            [flat(_first_values(sk)), flat(np.roll(deep, -1, axis=1)), pa.array(np.repeat(_head(batch.column("node")), TREES)), pa.array([x.tobytes() for x in small], pa.binary()).take(pa.array(np.repeat(np.arange(len(sk)), TREES)))],
            ["key", "deep", "h", "sk"],
        )


def connect(sk: np.ndarray, comp: np.ndarray, need: int) -> list[tuple[int, int]]:
    """Pairs that join the components of a window, by sketches that agree in ``need`` places."""
    out = []
    for i in range(len(sk)):
        other = np.flatnonzero(comp != comp[i])
        if not len(other):
            break
        hit = other[(sk[other] == sk[i]).sum(axis=1) >= need]
        for j in hit.tolist():
            if comp[j] != comp[i]:
                out.append((i, j))
                comp[comp == comp[j]] = comp[i]
    return out


def _candidates(need: int):
    """Rows come sorted by region and following values: pairs of short names that connect near nodes; and, with their
    range, the first and the last rows of it."""

    def look(key: np.ndarray, h: np.ndarray, sk: np.ndarray) -> tuple[list, list]:
        same = np.flatnonzero(key[1:] == key[:-1])
        near = same[(sk[same] == sk[same + 1]).sum(axis=1) >= need]
        u, v = [h[near]], [h[near + 1]]
        joined = np.zeros(len(key), bool)
        joined[near + 1] = True
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        ends = np.append(starts[1:], len(key))
        loose = np.add.reduceat(~joined, starts) if len(starts) else np.zeros(0)
        for lo, hi in zip(starts[loose > 1].tolist(), ends[loose > 1].tolist(), strict=True):
            if hi - lo > 2:
                for at in range(lo, hi, PLACES - CARRIED):
                    to = min(at + PLACES, hi)
                    more = connect(sk[at:to], np.cumsum(~joined[at:to]), need)
                    u.append(h[[at + i for i, _ in more]])
                    v.append(h[[at + j for _, j in more]])
        return u, v

    def found(u: np.ndarray, v: np.ndarray, ends: tuple | None = None, tail: bool = False) -> pa.RecordBatch:
        n, m = len(u), len(ends[0]) if ends else 0
        key, deep, h, sk = ends or [()] * 4
        lead, follow = [None] * n, [None] * m
        columns = [
            pa.array(np.minimum(u, v).tolist() + follow, pa.int64()), pa.array(np.maximum(u, v).tolist() + follow, pa.int64()), pa.array(lead + [TaskContext.get().partitionId()] * m, pa.int32()), pa.array(lead + [tail] * m, pa.bool_()),
            pa.array(lead + list(key), pa.int64()), pa.array(lead + list(deep), pa.int64()), pa.array(lead + list(h), pa.int64()), pa.array(lead + [x.tobytes() for x in sk], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["u", "v", "part", "tail", "key", "deep", "h", "sk"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, VALUES), np.uint8))
        held = head = tail = none

        def pairs(key, deep, h, sk) -> pa.RecordBatch:
            u, v = (np.concatenate(x) for x in look(key, h, sk))
            return found(u[u != v], v[u != v])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = tuple(batch.column(c).to_numpy() for c in ("key", "deep", "h")) + (_matrix(batch.column("sk"), np.uint8),)
            head = tuple(np.concatenate(x)[:CARRIED] for x in zip(head, now, strict=True)) if len(head[0]) < CARRIED else head
            tail = tuple(np.concatenate(x)[-CARRIED:] for x in zip(tail, now, strict=True))
            rows = tuple(np.concatenate(x) for x in zip(held, now, strict=True))
            cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last region may go on
            if len(rows[0]) - cut > 2 * PLACES:
                yield pairs(*rows)
                held = tuple(x[-CARRIED:] for x in rows)
            else:
                if cut:
                    yield pairs(*(x[:cut] for x in rows))
                held = tuple(x[cut:] for x in rows)
        if len(held[0]):
            yield pairs(*held)
            for ends, last in ((head, False), (tail, True)):
                part = ends[0] == (ends[0][-1] if last else ends[0][0])  # only the region that a cut may have split
                yield found(none[0], none[0], tuple(x[part] for x in ends), last)

    return run


def candidates(near: DataFrame, need: int) -> DataFrame:
    """Pairs (u, v) of short names, from all orders."""
    kind = "u bigint, v bigint, part int, tail boolean, key bigint, deep bigint, h bigint, sk binary"
    line = near.mapInArrow(_orders, "key bigint, deep bigint, h bigint, sk binary").repartitionByRange("key", "deep", "h").sortWithinPartitions("key", "deep", "h")
    found = written(line.mapInArrow(_candidates(need), kind), "candidates")
    ends = found.filter("part is not null")
    before = ends.select("part").distinct().select("part", F.lag("part").over(Window.orderBy("part")).alias("before"))  # a row a range
    cuts = ends.join(F.broadcast(before), "part").withColumn("cut", F.when(F.col("tail"), F.col("part")).otherwise(F.col("before"))).filter("cut is not null")
    over = cuts.select("cut", "key", "deep", "h", "sk").repartition("cut").sortWithinPartitions("key", "deep", "h").select("key", "deep", "h", "sk")
    both = found.filter("u is not null").select("u", "v").union(over.mapInArrow(_candidates(need), kind).filter("u is not null").select("u", "v"))
    out = written(both.distinct(), "pairs")
    discard(found)
    return out


def components(links: DataFrame) -> DataFrame:
    """node, label: nodes that links join, directly or not, have the same label. Nodes without links are left out."""
    edges, labels, turn = links.select("u", "v"), None, 0
    while True:
        rank = lambda c: F.xxhash64(F.lit(turn), c)  # noqa: B023, E731
        both = edges.union(edges.select("v", "u"))
        hook = both.groupBy("u").agg(F.min(F.struct(rank(F.col("v")).alias("r"), F.col("v"))).alias("m"))
        hook = hook.select("u", F.when(F.col("m.r") < rank(F.col("u")), F.col("m.v")).otherwise(F.col("u")).alias("p"))
        jump = hook.alias("h").join(hook.select(F.col("u").alias("p"), F.col("p").alias("q")).alias("g"), "p").select("u", F.col("q").alias("p"))
        hook = written(jump, "hooks")
        old = labels
        labels = hook.select(F.col("u").alias("node"), F.col("p").alias("label"))
        if old is not None:
            labels = old.join(labels.toDF("label", "p"), "label", "left").select("node", F.coalesce("p", "label").alias("label"))
        near, far = hook.select("u", F.col("p").alias("pu")), hook.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        moved = edges.join(near, "u").join(far, "v").filter("pu != pv")
        last, edges = edges, written(moved.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "edges")
        if turn:
            discard(last)
        turn += 1
        if edges.isEmpty():
            return labels


def _perhaps(grouped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(grouped.value, batch.column("ka").to_numpy())))

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(text, size).tobytes() for text in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("node", "region", "blocks")], pa.array(sets, pa.binary())], ["node", "region", "blocks", "s"])

    return run


def links(sets: list[bytes], comp: np.ndarray, asked: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Pairs (an asked set, another) with a similarity of ``least`` percent that join components; exact."""
    size = np.array([len(s) // 8 for s in sets])
    first = np.cumsum(size) - size
    known, flat = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_inverse=True)
    mark, out = np.zeros(len(known), np.int32), []
    for i in np.flatnonzero(asked).tolist():
        if (comp == comp[i]).all():
            continue
        mine = flat[first[i] : first[i] + size[i]]
        mark[mine] = 1
        both = np.add.reduceat(mark[flat], first)
        mark[mine] = 0
        for j in np.flatnonzero((100 * both >= least * (size + size[i] - both)) & (comp != comp[i])).tolist():
            if comp[j] != comp[i]:
                out.append((i, j))
                comp[comp == comp[j]] = comp[i]
    return out


def _compared(least: int):
    """Rows come sorted by cell: the links of each cell that join components. Cells are bounded by BLOCK."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, [], []

        def close() -> None:
            if len(rows) > 1:
                names, label, asked, sets = zip(*rows, strict=True)
                comp = np.unique(np.array([x.hex() for x in label]), return_inverse=True)[1]
                out.extend((names[i], names[j]) for i, j in links(list(sets), comp, np.array(asked), least))
            rows.clear()

        def found() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([f(p) for p in out], pa.binary()) for f in (min, max)], ["u", "v"])
            out.clear()
            return batch

        for batch in batches:
            cells = zip(*(batch.column(c).to_pylist() for c in ("region", "block", "other")), strict=True)
            for cell, row in zip(cells, zip(*(batch.column(c).to_pylist() for c in ("node", "label", "asked", "s")), strict=True), strict=True):
                if cell != now:
                    close()
                    now = cell
                rows.append(row)
            yield found()
        close()
        yield found()

    return run


def compare(cells: DataFrame, least: int) -> DataFrame:
    """cells: region, block, other, node, label, asked, s. The links between labels inside each cell."""
    line = cells.select("region", "block", "other", "node", "label", "asked", "s").repartition("region", "block", "other")
    found = line.sortWithinPartitions("region", "block", "other", "node").mapInArrow(_compared(least), "u binary, v binary")
    return written(found.distinct(), "links")


def _among(n: str, *salt) -> F.Column:
    """A place among ``n`` by the node's hash."""
    return F.pmod(F.xxhash64("node", *salt), F.col(n)).cast("int")


def _wide(sets: DataFrame, found: DataFrame, least: int, block: int) -> DataFrame:
    """Links between the blocks of groups that have several: all links with ``found``, the links inside blocks."""
    turn, before = 0, math.inf
    while True:
        named = sets.join(components(found), "node", "left").withColumn("label", F.coalesce("label", "node")).withColumn("size", F.octet_length("s") / 8)
        heads = named.groupBy("region", "label").agg(F.min_by("node", "size").alias("node"), F.min("size").alias("size"))
        many = heads.groupBy("region").agg(F.count("*").alias("labels"), F.ceil(F.sum("size") / block).cast("int").alias("n")).filter("labels > 1")
        many = written(many, "many")
        now = many.agg(F.sum("labels")).first()[0] or 0
        if 2 * now > before or not now:  # few components are left, or they lie apart
            break
        turn, before = turn + 1, now
        cells = sets.join(heads.join(many, "region").select("node", "label", "n"), "node")
        cells = cells.select("region", _among("n", F.lit(turn)).alias("block"), F.lit(0).alias("other"), "node", "label", F.lit(True).alias("asked"), "s")
        found = written(found.union(compare(cells, least)), "links")
    # Exactly what is left: all that is not in the largest component of its group meets every block of the group.
    sizes = named.groupBy("region", "label").agg(F.sum("size").alias("w"))
    most = sizes.groupBy("region").agg(F.max_by("label", F.struct("w", "label")).alias("most"), F.count("*").alias("labels"), (F.sum("w") - F.max("w")).alias("rest"))
    most = most.filter("labels > 1").select("region", "most", F.ceil(F.col("rest") / block).cast("int").alias("others"))
    left = named.join(most, "region")
    every = left.select("region", _among("blocks").alias("block"), F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("other"), "node", "label", F.lit(False).alias("asked"), "s")
    few = left.filter("label != most").select("region", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), _among("others", F.lit(3)).alias("other"), "node", "label", F.lit(True).alias("asked"), "s")
    return found.union(compare(every.union(few), least))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, least: int = 80, block: int = BLOCK) -> DataFrame:
    """One row a record: id, ka, kb (the text's key), n_shingles, label, component_id, kept. The label names the
    component, also where ids are null or repeated; a text without a set has its key's.

    Linked are texts whose shingle sets have a Jaccard similarity of ``least`` percent or more; ``block`` is
    the number of shingles that one task compares with each other."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("k"), F.col(text_col).alias("text")).select("id", "k.a", "k.b", "text").toDF("id", "ka", "kb", "text")
    described = written(rows.mapInArrow(_nodes(size), f"id {kind}, ka bigint, kb bigint, n bigint, node binary, sk binary"), "sketches")

    node = described.filter("node is not null").groupBy("node").agg(F.first("sk").alias("sk"), F.min(F.struct("ka", "kb")).alias("k"), F.min("n").alias("n"))
    place = node.mapInArrow(_places, "key bigint, h bigint").repartitionByRange("key", "h").sortWithinPartitions("key", "h")
    crowded = place.mapInArrow(_crowded, "h bigint").distinct()
    near = written(node.withColumn("h", _short("node")).join(crowded, "h", "left_semi"), "crowded")

    t = least / 100
    need = math.floor(VALUES * t - 5 * math.sqrt(VALUES * t * (1 - t)))  # five standard deviations of the estimate
    edges = candidates(near, need)
    region = components(edges).select(F.col("node").alias("h"), F.col("label").alias("region"))

    # One text of each set goes to its group; texts of no group and copies leave before the shuffle.
    group = written(region.join(near, "h").select("node", "region", "n", "k.ka", "k.kb"), "groups")
    grouped = bitmap(group, "ka")
    blocks = group.groupBy("region").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks"))
    perhaps = rows.select("ka", "kb", "text").mapInArrow(_perhaps(grouped), "ka bigint, kb bigint, text string")
    text = perhaps.groupBy("ka", "kb").agg(F.first("text").alias("text"))
    sets = text.join(group.join(blocks, "region"), ["ka", "kb"]).select("node", "region", "blocks", "text").mapInArrow(_sets(size), "node binary, region bigint, blocks int, s binary")
    sets = written(sets, "sets")
    discard(near, edges)
    inside = sets.select("region", _among("blocks").alias("block"), F.lit(0).alias("other"), "node", F.col("node").alias("label"), F.lit(True).alias("asked"), "s")
    found = compare(inside, least)
    wide = sets.filter("blocks > 1")
    if not wide.isEmpty():
        found = _wide(wide, found, least, block)
    label = components(found)

    # The smallest id goes from rows to nodes to components and back, so no step holds a group's rows.
    ids = described.filter("node is not null").groupBy("node").agg(F.min("id").alias("component_id"), F.count("*").alias("n"))
    named = ids.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = named.groupBy("label").agg(F.min("component_id").alias("component_id"), F.sum("n").alias("n")).filter("n > 1")
    named = named.select("node", "label").join(smallest.select("label", "component_id"), "label")
    out = described.drop("sk").join(named, "node", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    name = F.coalesce(F.hex(F.coalesce("label", "node")), F.concat_ws(" ", "ka", "kb"))
    return out.select("id", "ka", "kb", F.col("n").alias("n_shingles"), name.alias("label"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
