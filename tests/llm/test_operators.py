"""The ten operators against brute force on small fixtures, with their defined edge cases."""

import gzip
import hashlib
import random
import re
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import bpe, lengths, licenses, media, mixing, quality, sharding, substring, toxicity
from tidemark.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, n long"
BASE = " ".join(f"w{k * 7 % 101}x{k}" for k in range(120))
NEAR = BASE.replace("w7x1 ", "other ")


def table(spark, texts):
    rows = [(i, t, "en", s, len(t or ""), "clash", 1) for i, t, s in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    long = " ".join(f"long{k % 977} tail{k}" for k in range(20000))
    texts = [(1, BASE, "a"), (2, NEAR, "a"), (3, BASE, "b"), (4, None, None), (5, "", "b"), (6, "   \n\t ", "a"), (7, "one two", "c"), (8, "ONE two", "c"), (9, long, "a"), (10, "über straße x  y <|endoftext|> z", "b")]
    texts += [(11, "a b c " * 40, "c"), (12, "same row", "a"), (12, "same row", "a"), (None, "no id", "b"), (13, f"new {BASE[200:]} end", "c"), (14, "# $ % & " * 30, "b")]
    return table(spark, texts).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def test_substring_dedup(docs, empty):
    got = plain(substring.dedup(docs).withColumn("h", F.sha2(F.col("kept_text").cast("binary"), 256)), "id", "n_words", "n_removed", "h")
    assert got == sorted(brute.substring(rows_of(docs)), key=repr)
    assert substring.dedup(empty).count() == 0


def test_substring_factors_name_their_reference(docs):
    by_id = {r["id"]: r for r in substring.dedup(docs).collect()}
    assert any(f["ref_id"] is not None for f in by_id[3]["factors"])


def test_bpe_equals_the_library(docs, empty):
    from tokenizers import Tokenizer

    path = vocabulary()
    t = Tokenizer.from_file(path)
    exp = []
    for i, text in rows_of(docs):
        ids = t.encode(text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        exp.append((i, len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    got = plain(bpe.digests(bpe.encode(docs, path), path), "id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == sorted(exp, key=repr)
    back = {(r["id"], r["text"]) for r in bpe.decode(bpe.encode(docs, path), path).collect()}
    assert back == {(i, x or "") for i, x in rows_of(docs)}
    assert bpe.encode(empty, path).count() == 0
    small = bpe.encode(docs.withColumn("doc_id", F.col("doc_id").cast("smallint")).withColumn("ids", F.lit("clash")), path)
    assert small.schema["id"].dataType.simpleString() == "smallint" and plain(bpe.digests(small, path), "id", "ids_sha256") == plain(bpe.digests(bpe.encode(docs, path), path), "id", "ids_sha256")


@pytest.mark.parametrize("text", ["abc def" * 500, "x" * 5000, "1234 5678\t\tab <|endoftext|> cd" * 200, "日本語テキスト" * 300, "a  b \n\n c　d" * 400])
def test_joins_are_repaired_at_any_cut(text):
    c = bpe.codec(vocabulary())
    whole = c.encode([text])[0]
    assert c.decode_bytes(whole).decode() == text
    for step in (7, 301, 1000):
        parts = c.encode([text[k : k + step] for k in range(0, len(text), step)])
        assert c.repair(parts) == whole
    assert b"".join(bpe.chunks(text.encode())) == text.encode()


class Asked:
    """A tokenizer that notes the texts it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, []

    def encode_batch_fast(self, texts, **more):
        self.texts += texts
        return self.tokenizer.encode_batch_fast(texts, **more)


def test_bpe_gives_new_words_to_the_library_together():
    c = bpe.Codec(vocabulary())
    plain_ids = lambda x: c.tokenizer.encode(x, add_special_tokens=False).ids
    asked = Asked(c.tokenizer)
    odd = ["\x1cfoo\t bar", "one", "one\n\n two \n", "a\u3000 b\x85", " <|endoftext|> <|endof text|>x", " \n 日本 é\u0301 's'll 12!--", "", "x " * 50]
    texts = [*(" ".join(f"w{k}x{j}" for j in range(200)) for k in range(20)), *odd]
    expected = [plain_ids(t) for t in texts]
    c.tokenizer = asked
    assert [np.frombuffer(x, c.dtype).tolist() for x in c.encode(texts)] == expected
    assert len(asked.texts) < 60  # 4,000 words


def test_bpe_keeps_words_in_use_when_its_cache_is_full(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 500, raising=False)
    c = bpe.Codec(vocabulary())
    c.tokenizer = asked = Asked(c.tokenizer)
    for k in range(40):
        c.encode([" often" + "".join(f" v{k}y{j}" for j in range(200))])
        assert len(c.known) + len(c.before) < 2 * 700
    assert sum(t.count(" often") for t in asked.texts) == 1


def test_bpe_cuts_texts_for_chunks_by_one_job_only(docs):
    """What follows reads the pieces from a table; one pass is left, over the texts without shared chunks."""
    plan = bpe.encode(docs, vocabulary())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation") == 1


def test_bpe_decimals_and_bytes_of_all_ids():
    c = bpe.Codec(vocabulary())
    ids = np.array([*range(len(c.bytes))] * 3, c.dtype)  # more than one slab
    assert c.decimals(ids.tobytes()) == ",".join(map(str, ids.tolist())).encode() and c.decimals(b"") == b""
    assert c.decode_bytes(ids.tobytes()) == b"".join(c.bytes) * 3 and c.decode_bytes(b"") == b""


def test_lengths(docs, empty):
    c = bpe.codec(vocabulary())
    n = sorted(len(x) // 2 for x in c.encode([t or "" for _, t in rows_of(docs)]))
    got = {r["n_tokens"]: r for r in lengths.limits(lengths.histogram(docs, vocabulary())).collect()}
    assert set(got) == set(n)
    for k, r in got.items():
        assert (r["n_docs"], r["n_longer"], r["total_tokens"], r["truncated_tokens"]) == (n.count(k), sum(x > k for x in n), sum(n), sum(min(x, k) for x in n))
        assert r["n_at_least"] == sum(x >= k for x in n)
        for name, q in lengths.QUANTILES.items():
            cut = sorted(min(x, k) for x in n)
            assert r[name] == cut[next(i for i in range(len(cut)) if (i + 1) / len(cut) >= q)]
    for limit in (0, 1, 100, 10**7):
        a = lengths.answer(lengths.limits(lengths.histogram(docs, vocabulary())), limit).first()
        assert (a["n_fit"], a["n_cut"], a["tokens_left"]) == (sum(x <= limit for x in n), sum(x > limit for x in n), sum(min(x, limit) for x in n))
    assert lengths.limits(lengths.histogram(empty, vocabulary())).count() == 0


def test_media_payload_and_sniffing(docs, empty, spark):
    expected = []
    for i, text in rows_of(docs):
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        stored = media.as_wav(payload)
        expected.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), "text/plain", "audio/wav", True))
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "declared_type", "media_type", "type_corrected"]
    assert plain(media.features(media.store_texts(docs)), *names) == sorted(expected, key=repr)
    assert media.features(media.store_texts(docs, declared="audio/wav")).filter("type_corrected").count() == 0
    assert media.features(media.store_texts(empty)).count() == 0
    wav, gz = media.as_wav(b"abc"), __import__("gzip").compress(b"x" * 500)
    blobs = [(1, wav, "image/png"), (2, b"junk" + gz + wav + b"BM GIF89a", None), (3, None, "audio/wav"), (4, wav[:-2], "audio/wav"), (5, gz, "application/gzip")]
    out = {r["id"]: r for r in media.sniff(spark.createDataFrame(blobs, "id int, b binary, t string"), "b", "t", ["id"]).collect()}
    assert (out[1]["sniffed_type"], out[1]["media_length"], out[1]["type_corrected"]) == ("audio/wav", len(wav), True)
    assert [(c["offset"], c["length"], c["type"]) for c in out[2]["carved"]] == [(4, len(gz), "application/gzip"), (4 + len(gz), len(wav), "audio/wav")]
    assert out[3]["sniffed_type"] is None and out[4]["sniffed_type"] is None
    assert out[5]["type_corrected"] is False


def test_gzip_and_mp4_lengths():
    gz = gzip.compress(bytes(3 << 20)) + b"behind"
    assert media.objects(b"ab" + gz) == [(2, len(gz) - 6, "application/gzip")]
    box = lambda kind, body: struct.pack(">I4s", 8 + len(body), kind) + body
    wide = struct.pack(">I4sQ", 1, b"mdat", 16 + 100) + bytes(100)
    movie = box(b"ftyp", b"isom") + wide + box(b"moov", b"x" * 20)
    assert media.objects(movie) == [(0, len(movie), "video/mp4")]
    assert media.objects(box(b"ftyp", b"isom") + box(b"moov", b"") + struct.pack(">I4s", 0, b"mdat") + b"rest")[0][1] == 12 + 8 + 12


def naive_mix(rows):
    """(id, text, source) -> (id, size, source size, target, taken, reads, position, last position)."""
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    d = [(i, len(brute.words(t)), s, md5(" ".join(x for x in (None if i is None else str(i), md5(t or "")) if x is not None))) for i, t, s in rows]
    n = {s: sum(x[1] for x in d if x[2] == s) for s in {x[2] for x in d}}
    names = sorted(n, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(names)}
    ramp = {s: mixing.RAMPS[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(n.values())
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= 2 * n[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * n[s]
            left -= target[s]
        free -= over
    target |= {s: level * weight[s] for s in free}
    out, at = [], dict.fromkeys(names, 0)
    for i, size, s, _ in sorted(d, key=lambda x: (names.index(x[2]), x[3])):
        passes = int(target[s] // n[s]) if n[s] else 0
        part = max(min(int(target[s] - passes * n[s] + 0.5) - at[s], size), 0)
        reads = passes + (part > 0)
        a, b = ramp[s]

        def place(e, a=a, b=b, s=s, size=size):
            x = min((e * n[s] + at[s] + size / 2) / target[s], 1)
            lo, hi = 0.0, 1.0  # the rate runs from a to b; bisect its integral
            for _ in range(60):
                t = (lo + hi) / 2
                lo, hi = (t, hi) if (a * t + (b - a) * t * t / 2) / ((a + b) / 2) < x else (lo, t)
            return lo

        out.append((i, size, n[s], target[s], passes * size + part, reads, place(0) if reads else None, place(reads - 1) if reads else None))
        at[s] += size
    return out


def test_mixing(spark, docs, empty):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    for df, some in ((docs, rows), (table(spark, [(k % 7 if k % 3 else None, f"w{k} " * (k % 40), "abcd"[k % 11 % 4]) for k in range(300)]), None)):
        some = some or [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
        made = mixing.plan(df).select("doc_id", "size", "source_size", "target", "taken", F.size("positions"), F.get("positions", F.lit(0)), F.try_element_at("positions", F.lit(-1))).collect()
        key = lambda r: tuple(-1 if x is None else round(float(x), 6) for x in r)
        flat = lambda of: [x for r in sorted(map(key, of)) for x in r]
        assert flat(made) == pytest.approx(flat(naive_mix(some)), abs=2e-6)
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_a_mix_is_sorted_and_keeps_clashing_columns(spark):
    docs = table(spark, [(k, f"w{k} " * 10, "ab"[k % 2]) for k in range(200)]).withColumn("x", F.lit(1)).withColumn("positions", F.lit("clash")).withColumn("row", F.lit(2))
    place = {r["doc_id"]: r["positions"] for r in mixing.plan(docs, cut="whole").collect()}
    got = [r["doc_id"] for r in mixing.mix(docs).collect()]
    assert len(got) == sum(map(len, place.values()))
    read = {i: iter(p) for i, p in place.items()}
    order = [next(read[i]) for i in got]
    assert order == sorted(order)


def test_sharding(spark, docs, empty):
    many = table(spark, [(k, f"text {k % 900} " * (k % 900 % 40), "a") for k in range(3000)])
    groups = table(spark, [(k, f"big {k % 5} " * 9 if k % 4 == 0 else f"text {k} " * (k % 40), "a") for k in range(3000)])
    hot = table(spark, [(k, "hot " * 40 if k % 3 == 0 else f"text {k} " * (k % 40), "a") for k in range(3000)])
    for d, how in ((docs, {}), (many, {}), (many, {"per_piece": 20, "ranges": 4}), (groups, {}), (hot, {}), (hot, {"per_piece": 7, "ranges": 3})):
        rows, given = sharding.shard(d, **how).collect(), [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows_of(d)]
        assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=repr) == sorted(given, key=repr)
        assert {(r["law"], r["grown_shard"]) for r in rows} == {("bytes", None)}
        for s in {r["shard"] for r in rows}:
            assert 0 <= s < 8 and sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
        where = {(r["text_crc32"], r["shard"]) for r in rows}
        assert len(where) == len({c for c, _ in where})  # equal texts stay together, also where they exceed a shard
        size = sorted(sum(r["size"] for r in rows if r["shard"] == s) for s in range(8))
        if d is hot:
            assert size.pop() == sum(r["size"] for r in rows if r["doc_id"] % 3 == 0)
        if d is not docs:
            assert size[-1] <= 1.2 * size[0]
    assert sharding.shard(empty).count() == 0
    again = sharding.shard(hot.repartition(5), **how).collect()
    assert sorted((r["doc_id"], r["shard"]) for r in again) == sorted((r["doc_id"], r["shard"]) for r in rows)


def test_quality(docs, empty):
    def naive(text):
        w = brute.words(text)
        win = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        often = Counter(win)
        cover = {k + j for k, x in enumerate(win) if often[x] > 1 for j in range(3)}
        lines = [x for x in (text or "").encode().split(b"\n") if x.split()]
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        return len(w), sum(len(x.decode()) for x in w), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover), failed

    rows = quality.apply_policy(quality.ledger(docs), "full-1").withColumn("failed", F.col("fail_bits").bitwiseAND(F.lit(3)) != 0)
    got = plain(rows, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed")
    assert got == sorted(((i, *naive(t)) for i, t in rows_of(docs)), key=repr)
    assert rows.filter("kept != (fail_bits = 0)").count() == 0 and rows.filter("kept and failed").count() == 0
    ab = {r["rule"]: r for r in quality.ablations(rows, "full-1").collect()}
    kept = rows.filter("kept").count()
    assert all(r["n_kept_without"] == kept + r["n_failed_alone"] for r in ab.values())
    assert quality.ledger(empty).count() == 0


def naive_base(text):
    w = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    hits = [(k, label) for phrase, label in licenses.BASE.items() for p in [phrase.split()] for k in range(len(w)) if w[k : k + len(p)] == p]
    return len(w), len(hits), min((k for k, _ in hits), default=None), max((k for k, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))


def test_license_base_places(spark, docs):
    rng = random.Random(4)
    some = "cc by general public license all rights reserved x".split() + ["CC-BY", "General  Public\nLicense", "straße"]
    texts = [(k, " ".join(rng.choice(some) for _ in range(rng.randrange(60))), "a") for k in range(200)] + rows_of_three(docs)
    got = plain(licenses.scan(table(spark, texts)), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == sorted(((i, *naive_base(t)) for i, t, _ in texts), key=repr)


def rows_of_three(docs):
    return [(i, t, "a") for i, t in rows_of(docs)]


def test_licenses_take_time_in_proportion_to_words(spark):
    spent = {}
    for n in (50_000, 50_000, 500_000):
        df = table(spark, [(1, " ".join(f"w{k % 5000}" for k in range(n)) + " all rights reserved", "a")])
        start = time.monotonic()
        assert licenses.scan(df).first()["first_word"] == n
        spent[n] = time.monotonic() - start
    assert spent[500_000] < 20 * spent[50_000]


def test_licenses(spark, docs, empty):
    texts = [(1, "All rights reserved. ALL RIGHTS RESERVED, cc-by 4", "a"), (2, None, "a"), (3, "Licensed under the Apache License, Version 2.0.", "a"), (4, "licensed under the old apache license version 2.0", "a"), (5, "general public licence", "a"), (3, "Licensed under the Apache License, Version 2.0.", "a")]
    got = plain(licenses.scan(table(spark, texts)), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels")
    assert got == sorted([(1, 9, 3, 0, 6, "cc-by,reserved", "cc-by,reserved"), (2, 0, 0, None, None, "", ""), (3, 8, 0, None, None, "", "apache-2.0"), (3, 8, 0, None, None, "", "apache-2.0"), (4, 9, 0, None, None, "", "apache-2.0"), (5, 3, 0, None, None, "", "")], key=repr)
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(empty).count() == 0


def test_licenses_merge_before_they_vote(spark, monkeypatch):
    long = " ".join(f"term{k}" for k in range(150))
    monkeypatch.setitem(licenses.TEMPLATES, "long", [long])
    half = " ".join(long.split()[:90])
    texts = [(1, "Released under the X11/MIT license", "a"), (2, f"x {long} y", "a"), (3, half, "a"), (4, long.replace("term70 ", ""), "a"), (5, "under the mit", "a")]
    got = plain(licenses.scan(table(spark, texts)), "doc_id", "labels", "score")
    assert [r[:2] for r in got] == [(1, "mit"), (2, "long"), (3, ""), (4, "long"), (5, "")]
    assert got[0][2] == 0.75 and got[1][2] == 1.0 and got[3][2] == 147 / 149


def test_license_families_and_whole_texts(spark):
    def told(text):
        return f"Intro words here. {text} And more behind."

    texts = [told(t.capitalize()) for ts in licenses.TEMPLATES.values() for t in ts]
    labels = [label for label, ts in licenses.TEMPLATES.items() for _ in ts]
    names = [(told(t.upper()), label) for label, ts in licenses.NAMES.items() for t in ts]
    df = table(spark, [(k, t, "a") for k, t in enumerate([*texts, *[t for t, _ in names]])])
    got = {r["doc_id"]: set(r["labels"].split(",")) for r in licenses.scan(df).collect()}
    assert all(label in got[k] for k, label in enumerate([*labels, *[x for _, x in names]]))
    of = dict(zip([t for t, _ in names], range(len(texts), len(texts) + len(names)), strict=True))
    gpl2, gpl3, lgpl, agpl = (got[of[told(t.upper())]] for t in ("gnu general public license version 2", "gnu general public license version 3", "gnu lesser general public license", "gnu affero general public license"))
    assert "gpl-3.0" not in gpl2 and "gpl-2.0" not in gpl3 and "agpl" not in lgpl | gpl2 and "lgpl" not in agpl | gpl3
    half = " ".join(licenses.TEMPLATES["zlib"][0].split()[:25])
    assert licenses.scan(table(spark, [(1, half, "a"), (2, "the program of the software", "a")])).filter("labels <> ''").count() == 0


def test_forward_backward_matches_enumeration():
    import itertools
    import math

    import numpy as np

    rng = np.random.default_rng(1)
    moves = np.array([[0.0, -1.0], [0.3, 0.8]])
    lengths_ = np.array([4, 1, 0, 3])
    s = rng.normal(size=8)
    got, at = toxicity.forward_backward(s, lengths_, moves), 0
    for n in lengths_:
        part, weight = np.zeros(n), 0.0
        for tags in itertools.product((0, 1), repeat=int(n)):
            w = math.exp(sum(moves[a, b] for a, b in zip((0, *tags[:-1]), tags, strict=False)) + sum(s[at + k] for k, t in enumerate(tags) if t))
            weight += w
            part += w * np.array(tags)
        if n:
            assert np.allclose(got[at : at + n], part / weight)
        at += n
    long = rng.normal(size=1500)  # several blocks agree with one chain in short documents' blocks
    assert np.allclose(toxicity.forward_backward(long, np.array([1500]), moves)[:5], toxicity.forward_backward(long[:300], np.array([300]), moves)[:5])


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.train(*toxicity.sample(docs, labels))
    r = toxicity.score(docs, model).join(labels.withColumnRenamed("doc_id", "id"), "id").filter(toxicity.is_held_out("id"))
    c = {(x["toxic"], x["p"]): x["count"] for x in r.groupBy("toxic", (F.col("score") >= 0.5).alias("p")).count().collect()}
    assert c.get((0, True), 0) <= 0.02 * c[(0, False)]
    assert c[(1, True)] >= 0.9 * (c[(1, True)] + c.get((1, False), 0))


def test_one_long_text_costs_no_class(spark):
    trained = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5][:40]
    by_hash = [r.id for r in spark.createDataFrame([(i,) for i in trained], "id long").orderBy(F.xxhash64("id")).collect()]
    long = {by_hash[0], by_hash[1], by_hash[2]}  # first in line, of both classes
    docs = spark.createDataFrame([(i, "vile " * (2000 if i in long else 20)) for i in trained], "doc_id long, text string")
    labels = spark.createDataFrame([(i, by_hash.index(i) % 2) for i in trained], "doc_id long, toxic int")
    texts, toxic = toxicity.sample(docs, labels, class_bytes=8000)
    assert len(texts) == 37 and sum(toxic) == 19 and {len(t) for t in texts} == {100}
    assert len(toxicity.sample(docs, labels, class_bytes=1000)[0]) == 20  # ten of either class
    with pytest.raises(ValueError, match="longer"):
        toxicity.sample(docs.filter(F.length("text") > 1000), labels, class_bytes=8000)


def test_toxicity_edges(spark, docs, empty):
    none = toxicity.train([], [])
    assert toxicity.score(docs, none).filter("score >= 0.5").count() == 0
    assert toxicity.score(empty, none).count() == 0
    model = toxicity.train([b"you are a vile idiot", b"what a vile idiot he is", b"such vile words", b"a nice day", b"fine words here", b"hello there"] * 40, [1, 1, 1, 0, 0, 0] * 40)
    assert 0 <= model.score(1.0, 3.0) <= 1
    for texts, toxic in (([b""], [1]), ([b"", b"vile words", b" \n"], [0, 1, 0]), ([b"fine", b""], [0, 1])):  # labelled texts without words
        assert 0 <= toxicity.train(texts, toxic).score(0.0, 0.0) <= 1
