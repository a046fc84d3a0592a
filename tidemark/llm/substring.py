"""Substring deduplication by relative Lempel-Ziv parsing.

A document is factored greedily against reference blocks that all documents contribute.  Every window of
``window`` words has an anchor, the smallest hash among its word 8-grams; consecutive windows with one
anchor form a block (32 windows at most).  Only blocks with the same anchor can hold equal windows, so the
anchor is the index of the reference blocks: a block is parsed against all blocks of its anchor.

1. Index: anchors found twice; their blocks by content, each with its first and last place; and, where an
   anchor has several contents, its windows, each with its first and last place in a block.
2. Parse: from left to right a factor starts at the first window that has a reference elsewhere and
   follows that reference as long as its next windows do; of two references the one that goes further is
   taken.  A block that is found again as a whole is one factor.
3. Factor boundaries: factors of neighbouring blocks go on if they follow one reference; at each end the
   windows across it are looked up by their own references, so factors may overlap and end at the exact word.

Factors of ``window`` words or more are the duplicate spans: their words are removed, all occurrences alike.

Defined cases: null, empty and short texts (fewer words than a window) lose nothing; a repeated row is a
further place of its windows; texts with equal ids are told apart by their content; ties between references
go to the smaller place and change only the reference named; a very long text is held whole by one task (its words and 8
bytes a window), its blocks travel one by one; an empty table gives an empty result; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HASHES, bitmap, discard, in_bitmap, mixed, small_batches, text_key, utf8, written

WINDOW = 35
GRAM = 8
#: Windows in a block at most, and what a place inside it takes: a place is the block's content with its lowest
#: bits replaced by the number of the window.
INSIDE = 32
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(2 * n, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


def rolling(h: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` words, from prefix sums modulo 2**64."""
    n = len(h) - size + 1
    up, down = _power(len(h))
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * down[: len(h)], out=sums[1:])
    return mixed((sums[size:] - sums[:n]) * up[:n] + np.uint64(size))


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    done = 1
    while 2 * done <= size:
        x = np.minimum(x[: len(x) - done], x[done:])
        done *= 2
    rest = size - done
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def blocks(words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Window hashes, the first window of each block, and the anchors of the blocks."""
    if len(words) < window:
        return None
    h = HASHES.of(words)
    gram = min(GRAM, window)
    anchor = sliding_min(rolling(h, gram), window - gram + 1)
    runs = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    inside = np.arange(len(anchor)) - np.repeat(runs, np.diff(np.append(runs, len(anchor))))
    starts = np.flatnonzero(inside % INSIDE == 0)  # where a text repeats its anchor the run is cut
    # Least hashes lie close to zero: scrambled once more, they spread over a whole bit set.
    return rolling(h, window), starts, mixed(anchor[starts])


def own_repeats(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which blocks hold a window that the document has twice."""
    order = np.sort(hashes)
    twice = order[1:][order[1:] == order[:-1]]
    return np.logical_or.reduceat(np.isin(hashes, twice), starts) if len(twice) else np.zeros(len(starts), bool)


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, weight = [], []
            for text in utf8(batch.column(0)):
                if got := blocks(text.split(), window):
                    hashes, starts, anchor = got
                    found.append(anchor)
                    weight.append(1 + own_repeats(hashes, starts))
            if found:
                a, at = np.unique(np.concatenate(found), return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(np.bincount(at, np.concatenate(weight)).astype(np.int64))], ["a", "n"])

    return run


def _blocks(window: int, seen):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, first, size, anchor, content, own, hashes = [], [], [], [], [], [], []
            for r, text in enumerate(utf8(batch.column("text"))):
                if not (got := blocks(text.split(), window)):
                    continue
                w, starts, a = got
                ends = np.append(starts[1:], len(w))
                repeats = own_repeats(w, starts)
                for k in np.flatnonzero(in_bitmap(seen.value, a)):
                    part = w[starts[k] : ends[k]]
                    row.append(r)
                    first.append(starts[k])
                    size.append(len(part))
                    anchor.append(a[k])
                    content.append(xxhash.xxh3_64_intdigest(part.tobytes()))
                    own.append(bool(repeats[k]))
                    hashes.append(part)
            if row:
                offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
                as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
                values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(hashes).view(np.int64)))
                keys = [batch.column(c).take(pa.array(row)) for c in ("id", "ka", "kb")]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(np.array(first, np.int32)), pa.array(size, pa.int32()), as_long(anchor), as_long(content), pa.array(own, pa.bool_()), values], ["id", "ka", "kb", "s", "n", "a", "c", "own", "w"])

    return run


def _having(column: str, seen):
    """The rows whose hash in a column may be in a bit set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(seen.value, batch.column(column).to_numpy())))

    return run


def parse(windows: list[tuple[int, int, int]], own: int) -> list[tuple[int, int, int]]:
    """Factor a block greedily.  windows: (number, smallest and largest reference) of each window that has a
    reference elsewhere; ``own`` is the block's first place.  Factors: (first window, windows, reference)."""
    refs = {o: [r for r in dict.fromkeys((lo, hi)) if r != own + o] for o, lo, hi in windows}
    out, at, last = [], 0, max(refs, default=-1)
    while at <= last:
        best, length = None, 0
        for ref in refs.get(at, ()):
            n = 1
            while ref + n in refs.get(at + n, ()):
                n += 1
            if n > length:
                best, length = ref, n
        if best is None:
            at += 1
            continue
        out.append((at, length, best))
        at += length
    return out


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for a, c, windows in zip(*(batch.column(x).to_pylist() for x in ("a", "c", "windows")), strict=True):
            rows += [(a, c, o, n, ref & -INSIDE, ref & INSIDE - 1) for o, n, ref in parse(sorted((w["o"], w["lo"], w["hi"]) for w in windows), c & -INSIDE)]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["a", "c", "o", "n", "rc", "ro"])


def factors(marks: list[dict], window: int) -> list[tuple[int, int, object, int]]:
    """The factors of a document from those of its blocks: (first word, word behind the last, reference id, reference word).

    A factor goes on into the next block if one of that block's references follows its own."""
    out: list[list] = []
    for m in sorted(marks, key=lambda m: (m["s"], m["refs"][0]["s"])):
        lo, hi = m["s"], m["s"] + m["n"]
        moves = [(r["id"], r["s"] - lo) for r in m["refs"]]
        if out and lo <= out[-1][1] and (both := [x for x in out[-1][2] if x in moves]):
            out[-1][1:] = [max(out[-1][1], hi), both]
        else:
            out.append([lo, hi, moves])
    return [(lo, hi - 1 + window, moves[0][0], lo + moves[0][1]) for lo, hi, moves in out]


def _cut(window: int, touched=None):
    """The result rows. With ``touched``: only of texts that are surely not in that bit set, which lose nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_type = batch.column("id").type
            spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("ref_id", id_type), ("ref_start", pa.int64())]))
            if touched is not None:
                batch = batch.filter(pa.array(~in_bitmap(touched.value, batch.column("ka").to_numpy())))
            marked = [None] * batch.num_rows if touched is not None else batch.column("marks").to_pylist()
            kept, total, gone, spans = [], [], [], []
            for text, marks in zip(utf8(batch.column("text")), marked, strict=True):
                words = text.split()
                out = factors(marks or [], window)
                left = words
                if out:
                    cover = np.zeros(len(words) + 1, np.int32)
                    for lo, hi, _, _ in out:
                        cover[lo] += 1
                        cover[hi] -= 1
                    left = [w for w, c in zip(words, np.cumsum(cover[:-1]).tolist(), strict=True) if not c]
                kept.append(b" ".join(left).decode())
                total.append(len(words))
                gone.append(len(words) - len(left))
                spans.append([{"start": a, "end": b, "ref_id": r, "ref_start": s} for a, b, r, s in out])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("ka"), batch.column("kb"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, spans_type)], ["id", "ka", "kb", "n_words", "n_removed", "kept_text", "factors"])

    return run


def _reference(place: str, more=0):
    return F.struct(F.col(f"{place}.id").alias("id"), (F.col(f"{place}.s") + more).alias("s"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row a record: id, ka, kb (the text's key), n_words, n_removed, kept_text (one space between words), factors."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("k"), F.col(text_col).alias("text")).select("id", "k.a", "k.b", "text").toDF("id", "ka", "kb", "text")

    counts = rows.select("text").mapInArrow(_anchors(window), "a bigint, n bigint").groupBy("a").agg(F.sum("n").alias("n"))
    seen = bitmap(counts.filter("n > 1"), "a")
    kinds = f"id {kind}, ka bigint, kb bigint, s int, n int, a bigint, c bigint, own boolean, w array<bigint>"
    block = written(rows.mapInArrow(_blocks(window, seen), kinds), "blocks")

    place = F.struct("ka", "kb", "s", "id")
    once = written(block.groupBy("a", "c").agg(F.count("*").alias("n"), F.max("own").alias("own"), F.min(place).alias("lo"), F.max(place).alias("hi")), "blocks-once")
    refs = F.array(_reference("lo"), _reference("hi"))
    whole = once.filter("n > 1").select("a", "c", F.array(F.struct(F.lit(0).alias("o"), F.lit(None).cast("int").alias("n"), refs.alias("refs"))).alias("parts"))

    # Only anchors with different blocks, one of them found once, need a look at single windows.
    mixed_up = once.groupBy("a").agg(F.count("*").alias("m"), F.min("n").alias("n"), F.max("own").alias("own")).filter("n = 1 and (m > 1 or own)")
    edges = bitmap(mixed_up, "a")
    narrow = block.select("a", "c", "w").mapInArrow(_having("a", edges), "a bigint, c bigint, w array<bigint>").groupBy("a", "c").agg(F.count("*").alias("n"), F.first("w").alias("w"))
    narrow = written(narrow, "narrow")
    at = F.col("c").bitwiseAND(-INSIDE) + F.col("o")
    index = narrow.select("a", "c", "n", F.posexplode("w").alias("o", "w")).groupBy("a", "w").agg(F.sum("n").alias("n"), F.min(at).alias("lo"), F.max(at).alias("hi")).filter("n > 1").select("a", "w", "lo", "hi")
    single = narrow.filter("n = 1").select("a", "c", F.posexplode("w").alias("o", "w")).join(index, ["a", "w"]).groupBy("a", "c").agg(F.collect_list(F.struct("o", "lo", "hi")).alias("windows"))
    parsed = single.mapInArrow(_parsed, "a bigint, c bigint, o int, n int, rc bigint, ro int")
    known = once.select("a", F.col("c").bitwiseAND(-INSIDE).alias("rc"), F.col("lo"))
    parsed = parsed.join(known, ["a", "rc"]).select("a", "c", F.struct("o", "n", F.array(_reference("lo", F.col("ro"))).alias("refs")).alias("part"))
    marks = whole.unionByName(parsed.groupBy("a", "c").agg(F.collect_list("part").alias("parts")))

    marked = block.select("id", "ka", "kb", "s", "n", "a", "c").join(marks, ["a", "c"]).select("id", "ka", "kb", "s", "n", F.explode("parts").alias("p"))
    # A block that is its own first place refers to its last one.
    first = F.col("p.refs")[0]
    itself = first["id"].eqNullSafe(F.col("id")) & (first["s"] == F.col("s"))
    usable = F.when(F.col("p.n").isNull() & itself, F.reverse("p.refs")).otherwise(F.col("p.refs"))
    spans = marked.groupBy("id", "ka", "kb").agg(F.collect_set(F.struct((F.col("s") + F.col("p.o")).alias("s"), F.coalesce("p.n", "n").alias("n"), usable.alias("refs"))).alias("marks"))
    spans = written(spans, "marks")
    discard(block, once, narrow)

    touched = bitmap(spans, "ka")
    out = f"id {kind}, ka bigint, kb bigint, n_words bigint, n_removed bigint, kept_text string, factors array<struct<start:bigint,end:bigint,ref_id:{kind},ref_start:bigint>>"
    intact = rows.mapInArrow(_cut(window, touched), out)
    some = rows.mapInArrow(_having("ka", touched), rows.schema).alias("r")
    both = some.join(spans.alias("s"), F.expr("r.id <=> s.id and r.ka = s.ka and r.kb = s.kb"), "left").select("r.*", "s.marks")
    return intact.unionByName(both.mapInArrow(_cut(window), out))
