"""Each validator on a small object of its format: its length, what cuts and what lies behind it."""

import gzip
import struct
import zlib

import pytest

from tidemark.llm import media


def png():
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def jpeg():
    part = lambda kind, body: b"\xff" + bytes([kind]) + struct.pack(">H", len(body) + 2) + body
    return b"\xff\xd8" + part(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + part(0xC0, b"\x08\0\1\0\1\1\1\x11\0") + part(0xDA, b"\1\1\0\0\x3f\0") + b"\x12\xff\0\x34\xff\xd0\x56\xff\xd9"


def gif():
    return b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"\x21\xf9\x04\0\0\0\0\0" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\0" + b"\x3b"


def bmp():
    pixels = bytes(4 * 2)
    return struct.pack("<2sIIIIiiHHIIiiII", b"BM", 54 + len(pixels), 0, 54, 40, 1, 2, 1, 24, 0, len(pixels), 0, 0, 0, 0) + pixels


def webp():
    body = b"WEBP" + b"VP8L" + struct.pack("<I", 5) + b"\x2f\0\0\0\0" + b"\0"
    return b"RIFF" + struct.pack("<I", len(body)) + body


def pdf():
    return b"%PDF-1.4\n1 0 obj\n<<>>\nendobj\nxref\n0 1\ntrailer\n<<>>\nstartxref\n9\n%%EOF"


def crc(data, poly, bits):
    c = 0
    for x in data:
        c ^= x << (bits - 8)
        for _ in range(8):
            c = (c << 1) ^ (poly if c >> (bits - 1) & 1 else 0)
        c &= (1 << bits) - 1
    return c


def flac(frames=3, total=True):
    """Mono, 16 bits, blocks of 192 samples of one value each."""
    n = 192 * frames if total else 0
    info = struct.pack(">HH", 192, 192) + bytes(6) + (44100 << 44 | 0 << 41 | 15 << 36 | n).to_bytes(8, "big") + bytes(16)
    out = b"fLaC" + b"\x80" + len(info).to_bytes(3, "big") + info
    for k in range(frames):
        head = b"\xff\xf8\x19\x08" + bytes([k])
        head += bytes([crc(head, 0x07, 8)])
        frame = head + b"\0" + struct.pack(">h", 1000 + k)
        out += frame + struct.pack(">H", crc(frame, 0x8005, 16))
    return out


def mp4():
    box = lambda kind, body: struct.pack(">I4s", 8 + len(body), kind) + body
    return box(b"ftyp", b"isom") + box(b"moov", b"x" * 20) + box(b"mdat", b"y" * 9)


MADE = {"image/png": png(), "image/jpeg": jpeg(), "image/gif": gif(), "image/bmp": bmp(), "image/webp": webp(), "application/pdf": pdf(), "audio/flac": flac(), "video/mp4": mp4(), "audio/wav": media.as_wav(b"sample"), "application/gzip": gzip.compress(b"some text")}


def test_all_formats_are_covered():
    assert set(MADE) == set(media.VALIDATORS)


@pytest.mark.parametrize("kind", sorted(MADE))
def test_length_and_type(kind):
    blob = MADE[kind]
    assert media.objects(blob) == [(0, len(blob), kind)]
    assert media.objects(b"text before " + blob + b" text behind") == [(12, len(blob), kind)]
    assert media.objects(blob + MADE["image/gif"]) == [(0, len(blob), kind), (len(blob), len(MADE["image/gif"]), "image/gif")]


@pytest.mark.parametrize("kind", sorted(MADE))
def test_what_is_cut_off_is_nothing(kind):
    for cut in (1, len(MADE[kind]) // 2, len(MADE[kind]) - 5):
        assert media.objects(MADE[kind][:-cut]) == [] or kind == "video/mp4" and cut == 1  # boxes before a broken one are whole


def test_flac_frames_end_the_stream():
    assert media.objects(flac(2, total=False) + b"behind")[0][1] == len(flac(2, total=False))
    broken = bytearray(flac(3))
    broken[-1] ^= 1  # the last frame's checksum
    assert media.objects(bytes(broken)) == []


def test_a_wrong_checksum_or_size_is_nothing():
    bad = bytearray(png())
    bad[29] ^= 1
    assert media.objects(bytes(bad)) == []
    assert media.objects(b"BM" + bmp()[2:10] + struct.pack("<I", 9) + bmp()[14:]) == []
