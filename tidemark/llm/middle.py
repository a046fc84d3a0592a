"""Fill-in-the-middle: texts cut at ranked unit boundaries and put in prefix-suffix-middle order.

A text is a row of bits, one a byte.  ``bytes.translate`` maps its UTF-8 bytes to the digits of a class, and the
digits are one big integer, whose bit ``i`` tells whether byte ``i`` is in the class.  Shifted boolean operations
on such masks mark the unit boundaries and find the sentinels, ``bit_count`` gives the number of units and of code
points, and a rank is turned into a byte offset by recursive halving: count the bits of the lower half, go on with
the half that has the bit.  So a text costs a few passes over an eighth of its length, whatever its lines are.

A line ends behind its line feed; what follows the last one is a line too if it isn't empty.  Units may be code
points instead.  The cuts come from the id and a seed alone, so reruns agree.

Defined cases: null texts count as empty; an empty text, one that contains a sentinel and one beyond ``rate`` stay
as they are (form ``plain``); a null id counts as an empty string; equal rows get equal results and all stay; where
both cuts fall on one boundary the middle is empty; a very long text is one integer of an eighth of its size and is
written whole; an empty table gives an empty one; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, utf8

#: The sentinels: ``<`` and one of these letters and ``>``.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"


def _digits(members: bytes) -> bytes:
    return bytes(49 if k in members else 48 for k in range(256))


#: Translation tables of the byte classes: 1 for members, 0 for others.
LINE_FEED, OPENS, CLOSES, LETTER = _digits(b"\n"), _digits(b"<"), _digits(b">"), _digits(b"PSM")
GOES_ON = _digits(bytes(range(0x80, 0xC0)))


def mask(text: bytes, table: bytes) -> int:
    """The integer whose bit i is set where byte i is in the class."""
    return int(text.translate(table)[::-1], 2) if text else 0


def boundaries(text: bytes, unit: str = "line") -> int:
    """The starts of all units, and the end of the text."""
    full = (1 << len(text)) - 1
    starts = (mask(text, LINE_FEED) << 1) | 1 if unit == "line" else ~mask(text, GOES_ON)
    return (starts & full) | (1 << len(text))


def has_sentinel(text: bytes) -> bool:
    opens = mask(text, OPENS)
    return bool(opens) and bool(opens & (mask(text, LETTER) >> 1) & (mask(text, CLOSES) >> 2))


def select(bits: int, rank: int) -> int:
    """The place of the set bit with this rank, from 0."""
    place, width = 0, 1 << max(bits.bit_length() - 1, 0).bit_length()
    while width > 1:
        width >>= 1
        low = bits & ((1 << width) - 1)
        n = low.bit_count()
        if rank < n:
            bits = low
        else:
            rank, bits, place = rank - n, bits >> width, place + width
    return place


def draws(id: object, seed: int) -> list[int]:
    """Four numbers below 2**32 that depend on the id only."""
    digest = sha256(f"{seed}:{'' if id is None else id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


def transform(text: bytes, id: object, seed: int, rate: int, spm: int, unit: str) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, prefix_chars, middle_chars and output of one text."""
    h1, h2, h3, h4 = draws(id, seed)
    marks = boundaries(text, unit)
    n = marks.bit_count() - 1
    if not text or h3 % 100 >= rate or has_sentinel(text):
        return n, "plain", None, None, text
    a, b = sorted((select(marks, h1 % (n + 1)), select(marks, h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    points = boundaries(text, "char")
    before = [(points & ((1 << k) - 1)).bit_count() for k in (a, b)]
    if h4 % 100 < spm:
        form, out = "spm", (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)
    else:
        form, out = "psm", (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)
    return n, form, before[0], before[1] - before[0], b"".join(out)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm: int = 50, unit: str = "line") -> DataFrame:
    """One row a record: id, n (units), form, prefix_chars, middle_chars, output.

    ``rate`` percent of the texts are transformed, ``spm`` percent of those with the suffix first."""
    if unit not in ("line", "char"):
        raise ValueError(f"no such unit: {unit}")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            rows = [transform(text, i, seed, rate, spm, unit) for i, text in zip(ids.to_pylist(), utf8(batch.column("text")), strict=True)]
            n, form, before, middle, out = zip(*rows, strict=True) if rows else [()] * 5
            output = pa.array(out, pa.large_binary()).cast(pa.large_string()).cast(batch.schema.field("text").type)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(middle, pa.int64()), output], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Texts with sentinels stay plain, so the three in an output are its own."""
    part = F.split(output, "<[PSM]>")
    piece = lambda k: F.get(part, F.lit(k))
    return F.when(form == "psm", F.concat(piece(1), piece(3), piece(2))).when(form == "spm", F.concat(piece(2), piece(3), piece(1))).otherwise(output)
