"""SimHash near-duplicates against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.test_operators import docs, empty, rows_of, table  # noqa: F401
from tidemark.llm import simhash


def plain_fingerprint(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[k : k + size]) for k in range(len(words) - size + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, radius=3):
    """A label for each fingerprint, by all pairs."""
    fps = np.array(fps, np.uint64)
    label = np.arange(len(fps))
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= radius):
            if label[j] != label[i]:
                label[label == max(label[i], label[j])] = min(label[i], label[j])
    return label


@settings(max_examples=200, deadline=None)
@given(st.text("aB \n\té\x0b.", max_size=80))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_spark_hashes_alike(spark):
    words = ["one two three", "été à la", ""]
    got = [r[0] % 2**64 for r in spark.createDataFrame([(w,) for w in words], "w string").selectExpr("xxhash64(w)").collect()]
    assert got == [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]


def links_of(spark, fps, **how):
    df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp long")
    return {(r.u % 2**64, r.v % 2**64) for r in simhash.near_links(df, **how).collect()}


def check(spark, fps, **how):
    links = links_of(spark, fps, **how)
    assert all((u ^ v).bit_count() <= how.get("radius", 3) for u, v in links)
    at = {x: k for k, x in enumerate(fps)}
    label = np.arange(len(fps))
    for u, v in links:
        a, b = label[at[u]], label[at[v]]
        label[label == max(a, b)] = min(a, b)
    assert (label == classes(fps, how.get("radius", 3))).all()


@pytest.mark.parametrize(("crowd", "radius"), [(256, 3), (4, 3), (1, 3), (4, 2), (4, 0)])
def test_planted_distances(spark, crowd, radius):
    """Pairs at 1 to 5 bits, in all splits between the halves, one bit apart where the table is crowded, and a dense cloud."""
    rng = random.Random(crowd)
    fps = {0, 1, 2**64 - 1, 2**63}
    for far in (1, 2, 3, 4, 5):
        for _ in range(60):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample(range(64), far):
                y ^= 1 << b
            fps |= {x, y}
    centre = rng.getrandbits(64)
    for _ in range(300):
        y = centre
        for b in rng.sample(range(64), rng.randrange(1, 9)):
            y ^= 1 << b
        fps.add(y)
    top = rng.getrandbits(32) << 32  # one upper half with many lower ones, and its neighbours
    for _ in range(300):
        fps.add(top | rng.getrandbits(32))
        fps.add((top ^ (1 << rng.randrange(32, 64))) | (rng.getrandbits(32) if rng.random() < 0.5 else centre & 0xFFFFFFFF))
    check(spark, sorted(fps), crowd=crowd, radius=radius)


def test_a_crowded_half(spark):
    """Each lower half of 13 open bits under one upper half: one component of 8,192 nodes; every other one is alone or joined as by all pairs."""
    rng = random.Random(3)
    top = rng.getrandbits(32) << 32
    cloud = [top | k << 9 for k in range(1 << 13)]
    check(spark, cloud)
    check(spark, sorted({top | rng.getrandbits(32) for _ in range(3000)}))


def test_table(docs, empty, spark):  # noqa: F811
    rng = random.Random(1)
    base = [f"w{k}" for k in range(400)]
    near = []
    for k in range(60):
        words = list(base)
        words[rng.randrange(400)] = f"x{k}"
        near.append((100 + k, " ".join(words), "a"))
    every = docs.unionByName(table(spark, near))
    rows = rows_of(every)
    fps = [plain_fingerprint(t) for _, t in rows]
    label = classes(fps)
    least = {}
    for (i, _), c in zip(rows, label, strict=True):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    want = sorted(repr((i, f"{x:016x}", least.get(c))) for (i, _), x, c in zip(rows, fps, label, strict=True))
    for crowd in (256, 3):
        assert sorted(repr(tuple(r)) for r in simhash.near_duplicates(every, crowd=crowd).collect()) == want
    assert len({c for c in label[len(rows) - 60 :]}) < 60
    assert simhash.near_duplicates(empty).count() == 0
    with pytest.raises(ValueError, match="bits"):
        simhash.near_duplicates(docs, radius=4)
