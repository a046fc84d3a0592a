"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes cuts texts into chunks wherever the same bytes stand, so documents that
share a passage share its chunks.  Chunks found more than once in the corpus are encoded once; the rest of
a text is encoded where it is.  Joined chunk encodings can differ from the encoding of the whole text only
around a join, so each join is repaired: the tokens between the nearest places on either side at which the
pre-tokenizer surely cuts are encoded again, and where such a place is missing the stretch grows, up to
the whole text, until both ends agree with tokens of the chunks.  The ids are exactly the library's.

Byte-level BPE decodes without loss: every id stands for fixed bytes.

Defined cases: null counts as empty and has no ids; strings of special tokens in a text become their ids,
as in the library; repeated rows come back as often as they went in; texts with equal ids are told apart by
their content; there are no ties; a very long text travels chunk by chunk but is put together whole by one
task; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, in_bitmap, mixed, small_batches, text_key, utf8, written

AVERAGE, LEAST, WIDTH, SLAB = 1024, 256, 32, 1 << 20  # AVERAGE is a power of two
#: Words of one generation of the cache, of two; some 200 bytes each.
CACHED = 200_000
_UNIT = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_ODD = re.compile(r"[^\S \n]")


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level BPE writes for the 256 bytes: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """The tokenizer of a file, with the ids of recent words at hand."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        letters = _byte_letters()
        special = self.tokenizer.get_added_tokens_decoder()
        self.bytes: list[bytes] = [b""] * (max(self.tokenizer.get_vocab().values()) + 1)
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes[i] = special[i].content.encode() if i in special else bytes(letters[c] for c in token)
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        self.dtype = np.dtype("<u2" if len(self.bytes) <= 1 << 16 else "<u4")
        self._flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self._start = np.cumsum(self.length) - self.length
        self._decimal = np.array([f"{i}," for i in range(len(self.bytes))], "S")
        #: Between a printable ASCII character and a space or line feed the pre-tokenizer always cuts.
        self._ends_printable = np.array([b"!" <= b[-1:] <= b"~" for b in self.bytes])
        self._starts_blank = np.array([b[:1] in (b" ", b"\n") for b in self.bytes])
        self.by_word = not any(re.search(r"\s", t.content) or t.lstrip or t.rstrip for t in special.values())
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def units(self, text: str) -> list[str]:
        """Pieces that are encoded independently: white space with the word that follows it."""
        if not self.by_word:
            return [text] if text else []
        out = _UNIT.findall(text)
        if _ODD.search(text):  # a piece that ends in other white space belongs to the next one
            joined, held = [], ""
            for u in out:
                held += u
                if not held[-1].isspace():
                    joined.append(held)
                    held = ""
            out = [*joined, held] if held else joined
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text."""
        out = []
        for at in range(0, len(texts), 64):
            split = [self.units(t) for t in texts[at : at + 64]]
            if len(self.known) > CACHED:  # words still in use come back from the generation before
                self.known, self.before = {}, self.known
            known = self.known
            self._learn(set().union(*split).difference(known))
            out += [b"".join(map(known.__getitem__, units)) for units in split]
        return out

    def _learn(self, new: set[str]) -> None:
        """Units between two of which the pre-tokenizer surely cuts are given to the library as one text."""
        known, before, one, together = self.known, self.before, [], []
        for u in new:
            if u in before:
                known[u] = before[u]
            elif self.by_word and u[0] in " \n" and not u[-1].isspace():
                together.append(u)
            else:
                one.append(u)
        for k in range(0, len(together), 4096):
            part = together[k : k + 4096]
            ids = self._ids(["".join(part)])[0]
            ends = np.cumsum(self.length[ids])
            places = np.cumsum([len(u) if u.isascii() else len(u.encode()) for u in part])
            stops = np.searchsorted(ends, places) + 1
            if stops[-1] != len(ids) or (ends[stops - 1] != places).any():  # a token reaches over two units
                one += part
                continue
            packed, size, last = ids.tobytes(), self.dtype.itemsize, 0
            for u, stop in zip(part, (stops * size).tolist(), strict=True):
                known[u] = packed[last:stop]
                last = stop
        for k in range(0, len(one), 4096):
            part = one[k : k + 4096]
            known.update(zip(part, [ids.tobytes() for ids in self._ids(part)], strict=True))

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def decode_bytes(self, ids: bytes) -> bytes:
        every, out = np.frombuffer(ids, self.dtype), []
        for at in range(0, len(every), SLAB >> 4):
            part = every[at : at + (SLAB >> 4)]
            n = self.length[part]
            ends = np.cumsum(n)
            out.append(self._flat[np.repeat(self._start[part] - ends + n, n) + np.arange(ends[-1])].tobytes())
        return b"".join(out)

    def decimals(self, ids: bytes) -> bytes:
        """The ids in decimal, joined by commas."""
        return self._decimal[np.frombuffer(ids, self.dtype)].tobytes().translate(None, b"\0")[:-1]

    def repair(self, parts: list[bytes]) -> bytes:
        """The ids of the whole text from those of its chunks."""
        if len(parts) < 2:
            return b"".join(parts)
        ids = np.frombuffer(b"".join(parts), self.dtype)
        joins = np.cumsum([len(p) // self.dtype.itemsize for p in parts[:-1]])
        # Places that are ends of tokens too; stretches between them are equal or apart
        safe = np.concatenate(([0], np.flatnonzero(self._ends_printable[ids[:-1]] & self._starts_blank[ids[1:]]) + 1, [len(ids)]))
        lo, hi = safe[np.searchsorted(safe, joins, "right") - 1].tolist(), safe[np.searchsorted(safe, joins, "left")].tolist()
        stretches = sorted({(a, b) for a, b in zip(lo, hi, strict=True) if a < b})
        again = self.encode([self.decode_bytes(ids[a:b].tobytes()).decode() for a, b in stretches])
        out, done = [], 0
        for (a, b), new in zip(stretches, again, strict=True):
            out += [ids[done:a].tobytes(), new]
            done = b
        return b"".join([*out, ids[done:].tobytes()])


@lru_cache(1)
def codec(path: str) -> Codec:
    return Codec(path)


_GEAR = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD_BASE = 0xD6E8FEB86659FD93


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (_ODD_BASE, pow(_ODD_BASE, -1, 1 << 64)):
        steps = np.full(SLAB + WIDTH, b, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps))
    return out[0], out[1]


def chunks(text: bytes) -> list[bytes]:
    """Cut behind each place whose last WIDTH bytes hash to a multiple of AVERAGE, LEAST bytes apart or more."""
    if len(text) < 2 * LEAST:
        return [text] if text else []
    up, down = _powers()
    raw, places = np.frombuffer(text, np.uint8), []
    for at in range(0, len(raw) - WIDTH + 1, SLAB):
        part = _GEAR[raw[at : at + SLAB + WIDTH - 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * down[: len(part)], out=sums[1:])
        n = len(part) - WIDTH + 1
        h = (sums[WIDTH:] - sums[:n]) * up[:n]
        places.append(np.flatnonzero(h & np.uint64((AVERAGE - 1) << 40) == 0) + at + WIDTH)
    out, last = [], 0
    for p in np.concatenate(places).tolist():
        while p < len(text) and text[p] & 0xC0 == 0x80:  # not inside a character
            p += 1
        if p - last >= LEAST and p < len(text):
            out.append(text[last:p])
            last = p
    return [*out, text[last:]]


def _key(chunk: bytes) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


def _heads(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(k[:8] for k in keys), np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [_key(c) for text in utf8(batch.column("text")) for c in chunks(text)]
        h, n = np.unique(_heads(keys), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["h", "n"])


def _shared_in(text: bytes, shared: np.ndarray) -> tuple[list[bytes], list[bytes], list[bool]]:
    pieces = chunks(text)
    keys = [_key(c) for c in pieces]
    return pieces, keys, in_bitmap(shared, _heads(keys)).tolist() if keys else []


def _alone(path: str, shared):
    """Encode the texts without any shared chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = utf8(batch.column("text"))
            keep = [k for k, t in enumerate(texts) if not any(_shared_in(t, shared.value)[2])]
            rows = batch.select(["id", "ka", "kb"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(c.encode([texts[k].decode() for k in keep]), pa.binary())], ["id", "ka", "kb", "ids"])

    return run


def _pieces(path: str, shared):
    """The chunks of the other texts: a key for a shared one, with its text where the task meets it first, and the
    ids of what lies between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        seen: set[bytes] = set()
        for batch in batches:
            row, seq, key, own, chunk = [], [], [], [], []
            for k, text in enumerate(utf8(batch.column("text"))):
                pieces, keys, hits = _shared_in(text, shared.value)
                if not any(hits):
                    continue
                for s, (piece, name, hit) in enumerate(zip(pieces, keys, hits, strict=True)):
                    if not hit and s and not hits[s - 1]:
                        own[-1] += piece
                        continue
                    row.append(k)
                    seq.append(s)
                    key.append(name if hit else None)
                    own.append(None if hit else piece)
                    chunk.append(piece.decode() if hit and name not in seen else None)
                    if hit:
                        seen.add(name)
            if len(seen) > 500_000:
                seen.clear()
            literal = iter(c.encode([x.decode() for x in own if x is not None]))
            rows = batch.select(["id", "ka", "kb"]).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(seq, pa.int32()), pa.array(key, pa.binary()), pa.array([None if x is None else next(literal) for x in own], pa.binary()), pa.array(chunk, pa.string())],
                ["id", "ka", "kb", "seq", "key", "own", "chunk"],
            )

    return run


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(codec(path).encode(batch.column("chunk").to_pylist()), pa.binary())], ["key", "ids"])

    return run


def _joined(path: str):
    """Rows come sorted by text and place: put each text together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        now, parts, times = None, {}, 0
        out: list[tuple] = []
        id_type: pa.DataType | None = None

        def close() -> None:
            if now is not None:
                out.extend([(*now, c.repair([parts[s] for s in sorted(parts)]))] * times)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [id_type, pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["id", "ka", "kb", "ids"])

        for batch in batches:
            id_type = batch.column("id").type
            cols = [batch.column(n).to_pylist() for n in ("id", "ka", "kb", "seq", "ids")]
            for i, a, b, seq, ids in zip(*cols, strict=True):
                if (i, a, b) != now:
                    close()
                    now, parts, times = (i, a, b), {}, 0
                times += seq == 0
                parts[seq] = ids
            if len(out) > 200:
                yield batch_of(out)
                out.clear()
        close()
        if out:
            yield batch_of(out)

    return run


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("k"), F.col(text_col).alias("text"))
    return rows.select("id", F.col("k.a").alias("ka"), F.col("k.b").alias("kb"), "text")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a record: id, ka, kb (the text's key) and ``ids``, packed little-endian (2 bytes up to 65,536 ids)."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = keyed(docs, id_col, text_col)
    counts = rows.select("text").mapInArrow(_counted, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    shared = bitmap(counts.filter("n > 1"), "h")
    base = f"id {kind}, ka bigint, kb bigint"
    alone = rows.mapInArrow(_alone(path, shared), f"{base}, ids binary")
    pieces = written(rows.mapInArrow(_pieces(path, shared), f"{base}, seq int, key binary, own binary, chunk string"), "pieces", "zstd")
    between = pieces.filter("key is null").select("id", "ka", "kb", "seq", F.col("own").alias("ids"))
    once = pieces.filter("chunk is not null").groupBy("key").agg(F.first("chunk").alias("chunk")).mapInArrow(_encoded(path), "key binary, ids binary")
    full = between.unionByName(pieces.filter("key is not null").select("id", "ka", "kb", "seq", "key").join(once, "key").drop("key"))
    put = full.repartition("id", "ka", "kb").sortWithinPartitions("id", "ka", "kb", "seq").mapInArrow(_joined(path), f"{base}, ids binary")
    return alone.unionByName(put)


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = [c.decode_bytes(x).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``text`` to rows with packed ``ids``."""
    kinds = ", ".join(f"{n} {t}" for n, t in encoded.dtypes)
    return encoded.mapInArrow(_decoded(path), f"{kinds}, text string")


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            n, of_ids, of_text = [], [], []
            for packed in batch.column("ids").to_pylist():
                n.append(len(packed) // c.dtype.itemsize)
                of_ids.append(hashlib.sha256(c.decimals(packed)).hexdigest())
                of_text.append(hashlib.sha256(c.decode_bytes(packed).decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 of encoded rows."""
    kind = encoded.schema["id"].dataType.simpleString()
    return encoded.select("id", "ids").mapInArrow(_digests(path), f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
