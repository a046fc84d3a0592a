"""Signature sniffing for media columns.

One Aho-Corasick automaton finds the magic bytes of all formats in a single pass over a value.  A magic
alone proves little, so each hit is handed to a validator of its format, which walks the structure,
checks the lengths (and checksums where there are any) and says where the object ends.  A valid object at
offset 0 corrects the declared type; valid objects further in are carved.

Defined cases: null and empty values have type null, length 0 and carve nothing; a declared type that is
null is corrected like a wrong one; objects inside an object already carved are not reported again; of two
objects at one place the type first in order counts; repeated rows come back as often as they went in; a very
long value is held whole by one task, inflated data never; the end of a FLAC stream is not looked for, it takes the
rest of its value; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

OCTETS = "application/octet-stream"
#: Fixed values of the formats: magic bytes, and how far into the object they stand.
MAGIC = {
    b"\x89PNG\r\n\x1a\n": ("image/png", 0),
    b"\xff\xd8\xff": ("image/jpeg", 0),
    b"GIF87a": ("image/gif", 0),
    b"GIF89a": ("image/gif", 0),
    b"BM": ("image/bmp", 0),
    b"WAVE": ("audio/wav", 8),
    b"WEBP": ("image/webp", 8),
    b"%PDF-": ("application/pdf", 0),
    b"\x1f\x8b\x08": ("application/gzip", 0),
    b"fLaC": ("audio/flac", 0),
    b"ftyp": ("video/mp4", 4),
}


def _png(b: bytes, at: int) -> int:
    p, first = at + 8, True
    while p + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, p)
        if p + 12 + size > len(b) or (first and (kind != b"IHDR" or size != 13)):
            return 0
        if zlib.crc32(b[p + 4 : p + 8 + size]) != struct.unpack_from(">I", b, p + 8 + size)[0]:
            return 0
        p, first = p + 12 + size, False
        if kind == b"IEND":
            return p - at
    return 0


def _jpeg(b: bytes, at: int) -> int:
    p, frame = at + 2, False
    while p + 4 <= len(b) and b[p] == 0xFF:
        kind = b[p + 1]
        size = struct.unpack_from(">H", b, p + 2)[0]
        if size < 2:
            return 0
        frame |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        p += 2 + size
        if kind == 0xDA:  # entropy-coded data up to the next marker that is not a restart or a stuffed byte
            while (p := b.find(b"\xff", p)) >= 0 and p + 1 < len(b):
                if b[p + 1] == 0xD9:
                    return p + 2 - at if frame else 0
                if b[p + 1] and not 0xD0 <= b[p + 1] <= 0xD7:
                    break
                p += 2
            if p < 0:
                return 0
    return 0


def _gif(b: bytes, at: int) -> int:
    if at + 13 > len(b):
        return 0
    flags, p = b[at + 10], at + 13
    p += 3 << ((flags & 7) + 1) if flags & 0x80 else 0
    while p < len(b):
        kind = b[p]
        if kind == 0x3B:
            return p + 1 - at
        if kind == 0x21:
            p += 2
        elif kind == 0x2C and p + 10 <= len(b):
            local = b[p + 9]
            p += 10 + (3 << ((local & 7) + 1) if local & 0x80 else 0) + 1
        else:
            return 0
        while p < len(b) and b[p]:
            p += b[p] + 1
        p += 1
    return 0


def _bmp(b: bytes, at: int) -> int:
    if at + 54 > len(b):
        return 0
    size, _, pixels, header, width, height, planes, depth = struct.unpack_from("<IIIIiiHH", b, at + 2)
    if planes != 1 or header not in (40, 52, 56, 108, 124) or depth not in (1, 4, 8, 16, 24, 32) or width <= 0:
        return 0
    need = (width * depth + 31) // 32 * 4 * abs(height)
    return size if pixels >= 14 + header and size >= pixels + need and at + size <= len(b) else 0


def _riff(form: bytes, must: bytes):
    def check(b: bytes, at: int) -> int:
        if at < 0 or b[at : at + 4] != b"RIFF" or at + 12 > len(b):
            return 0
        end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
        p, seen = at + 12, set()
        while p + 8 <= min(end, len(b)):
            kind, size = struct.unpack_from("<4sI", b, p)
            seen.add(kind)
            p += 8 + size + (size & 1)
        return end - at if end <= len(b) and p == end and any(k.startswith(must) for k in seen) and (form != b"WAVE" or b"fmt " in seen) else 0

    return check


def _pdf(b: bytes, at: int) -> int:
    end = b.find(b"%%EOF", at)
    return end + 5 - at if end > 0 and b.find(b"startxref", at, end) > 0 else 0


def _gzip(b: bytes, at: int) -> int:
    """Inflate 64 KiB at a time into pieces of a MiB that are thrown away, so memory stays bounded."""
    d, view, p = zlib.decompressobj(31), memoryview(b), at
    try:
        while not d.eof and (p < len(b) or d.unconsumed_tail):
            part = d.unconsumed_tail
            if not part:
                part, p = view[p : p + 65536], p + 65536
            d.decompress(part, 1 << 20)
    except zlib.error:
        return 0
    return min(p, len(b)) - at - len(d.unused_data) if d.eof else 0


def _crc_table(poly: int, bits: int) -> list[int]:
    out = []
    for k in range(256):
        c = k << (bits - 8)
        for _ in range(8):
            c = (c << 1) ^ (poly if c >> (bits - 1) & 1 else 0)
        out.append(c & ((1 << bits) - 1))
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _flac_frame(b: bytes, p: int) -> tuple[int, int]:
    """Length of the frame header at p and the samples of the frame; zeros if there is none."""
    if p + 6 > len(b) or b[p] != 0xFF or b[p + 1] & 0xFE != 0xF8:
        return 0, 0
    block, rate = b[p + 2] >> 4, b[p + 2] & 15
    if not block or rate == 15 or b[p + 3] & 1 or b[p + 3] >> 4 > 10:
        return 0, 0
    lead = b[p + 4]
    q = p + 5 + (0 if lead < 0x80 else next((k for k in range(1, 7) if lead < 256 - (1 << (6 - k))), 6))  # the number of the frame, coded as in UTF-8
    samples = {1: 192, 6: int.from_bytes(b[q : q + 1], "big") + 1, 7: int.from_bytes(b[q : q + 2], "big") + 1}.get(block) or (576 << (block - 2) if block < 6 else 256 << (block - 8))
    q += {6: 1, 7: 2}.get(block, 0) + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    c = 0
    for x in b[p : q + 1]:
        c = _CRC8[c ^ x]
    return (q + 1 - p, samples) if q < len(b) and c == 0 else (0, 0)


def _flac(b: bytes, at: int) -> int:
    """Metadata blocks, then frames: a frame ends where its checksum is met and the next frame, or the end of the stream, follows."""
    p, first, total = at + 4, True, 0
    while True:
        if p + 4 > len(b):
            return 0
        kind, size = b[p] & 0x7F, int.from_bytes(b[p + 1 : p + 4], "big")
        if (first and (kind, size) != (0, 34)) or kind == 127 or p + 4 + size > len(b):
            return 0
        if first:
            total = int.from_bytes(b[p + 17 : p + 22], "big") & 0xFFFFFFFFF
        last, p, first = b[p] & 0x80, p + 4 + size, False
        if last:
            break
    done = 0
    while True:
        head, samples = _flac_frame(b, p)
        if not head:
            return 0
        done, c, q, end = done + samples, 0, p, 0
        while q < len(b):
            c = (c << 8 & 0xFFFF) ^ _CRC16[c >> 8 ^ b[q]]
            q += 1
            if c == 0 and q > p + head + 2:
                if (total and done >= total) or (not total and not _flac_frame(b, q)[0]):
                    return q - at
                if _flac_frame(b, q)[0]:
                    end = q
                    break
        if not end:
            return 0
        p = end


def _mp4(b: bytes, at: int) -> int:
    p, kinds = at, []
    while at >= 0 and p + 8 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, p)
        if size == 1 and p + 16 <= len(b):  # a 64-bit size
            size = struct.unpack_from(">Q", b, p + 8)[0]
        elif size == 0:  # up to the end of the value
            size = len(b) - p
        if size < 8 or p + size > len(b) or not kind.isalnum():
            break
        kinds.append(kind)
        p += size
    return p - at if kinds[:1] == [b"ftyp"] and {b"moov", b"moof"} & set(kinds) else 0


VALIDATORS = {
    "image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp, "audio/wav": _riff(b"WAVE", b"data"), "image/webp": _riff(b"WEBP", b"VP8"),
    "application/pdf": _pdf, "application/gzip": _gzip, "audio/flac": _flac, "video/mp4": _mp4,
}
_automaton = None


def signatures(blob: bytes) -> Iterator[tuple[int, str]]:
    """Start and type of everything that begins with a magic, in order of the magic's place."""
    global _automaton
    if _automaton is None:
        _automaton = ahocorasick.Automaton()
        for magic, (kind, back) in MAGIC.items():
            _automaton.add_word(magic.decode("latin-1"), (len(magic) - 1 + back, kind))
        _automaton.make_automaton()
    for end, (back, kind) in _automaton.iter(blob.decode("latin-1")):
        yield end - back, kind


def objects(blob: bytes) -> list[tuple[int, int, str]]:
    """Valid objects (offset, length, type) in order; those inside an earlier one are left out."""
    found, to = [], 0
    for at, kind in sorted(set(signatures(blob))):
        if at >= to and (size := VALIDATORS[kind](blob, at)):
            found.append((at, size, kind))
            to = at + size
    return found


FOUND = "sniffed_type string, media_length bigint, type_corrected boolean, carved array<struct<offset:bigint,length:bigint,type:string>>"


def _sniffed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    inner = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string())]))
    for batch in batches:
        kinds, sizes, wrong, carved = [], [], [], []
        for blob, said in zip(batch.column("__blob").to_pylist(), batch.column("__said").to_pylist(), strict=True):
            got = objects(blob or b"")
            top = got[0] if got and got[0][0] == 0 else (0, 0, None)
            kinds.append(top[2])
            sizes.append(top[1])
            wrong.append(top[2] is not None and top[2] != said)
            carved.append([{"offset": a, "length": n, "type": k} for a, n, k in got if a > 0])
        keep = [n for n in batch.schema.names if n not in ("__blob", "__said")]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(n) for n in keep], pa.array(kinds, pa.string()), pa.array(sizes, pa.int64()), pa.array(wrong), pa.array(carved, inner)],
            [*keep, "sniffed_type", "media_length", "type_corrected", "carved"],
        )


def sniff(media: DataFrame, blob_col: str, declared_col: str, keep: list[str]) -> DataFrame:
    """The kept columns with the type found, its length, whether the declared type was wrong, and what was carved."""
    small_batches(media.sparkSession, 200)
    kinds = ", ".join(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in keep)
    return media.select(*keep, F.col(blob_col).alias("__blob"), F.col(declared_col).alias("__said")).mapInArrow(_sniffed, f"{kinds}, {FOUND}")


def as_wav(payload: bytes, rate: int = 8000) -> bytes:
    """The bytes as 8-bit mono samples."""
    pad = len(payload) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + bytes(pad)


def wav_samples(blob: bytes) -> bytes:
    """The samples of a RIFF file: the data chunk."""
    p = 12
    while p + 8 <= len(blob):
        kind, size = struct.unpack_from("<4sI", blob, p)
        if kind == b"data":
            return blob[p + 8 : p + 8 + size]
        p += 8 + size + (size & 1)
    return b""


def padded(data: bytes, unit: int = 64) -> bytes:
    """Zeros up to a positive multiple of ``unit``."""
    return data + bytes(-len(data) % unit if data else unit)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [x or b"" for x in batch.column(1).cast(pa.large_binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([as_wav(padded(x)) for x in texts], pa.binary())], ["id", "n_bytes", "media"])


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: str = "text/plain") -> DataFrame:
    """id, n_bytes, ``media``: each text as a WAV file of 8-bit samples, and the type that the source declares."""
    small_batches(docs.sparkSession, 200)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_store, f"id {kind}, n_bytes bigint, media binary").withColumn("declared_type", F.lit(declared))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for blob, said in zip(batch.column("media").to_pylist(), batch.column("declared_type").to_pylist(), strict=True):
            got = objects(blob)
            kind = got[0][2] if got and got[0][0] == 0 else OCTETS
            data = wav_samples(blob) if kind == "audio/wav" else blob
            inside = objects(data)
            x = np.frombuffer(data, np.uint8)
            total, square = int(x.sum(dtype=np.int64)), int((x.astype(np.int64) ** 2).sum())
            wrong = kind != OCTETS and kind != said
            feature = f"type={kind};samples={len(x)};sum={total};squares={square};embedded={'+'.join(k for _, _, k in inside) or 'none'}"
            rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(blob), hashlib.sha256(blob).hexdigest(), feature, said, kind, wrong))
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "declared_type", "media_type", "type_corrected"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]], ["id", "n_bytes", *names])


def features(stored: DataFrame) -> DataFrame:
    """Read stored media back: sniff the type, correct the declared one, take the samples out by it, and describe them."""
    kind = stored.schema["id"].dataType.simpleString()
    out = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, declared_type string, media_type string, type_corrected boolean"
    return stored.select("id", "n_bytes", "media", "declared_type").mapInArrow(_features, f"id {kind}, n_bytes bigint, {out}")
