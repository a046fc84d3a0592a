"""Near-duplicates against all pairs, above all where many texts lie just below the threshold."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.test_operators import docs, empty, rows_of, table  # noqa: F401
from tidemark.llm import minhash


def found(df, **how):
    return {r["id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, size=3, least=85, **how).collect()}


def variants(n, words, changed, seed, first=0):
    """Texts of one source, each with some words changed at random."""
    rng = random.Random(seed)
    base = [f"b{seed}w{k}" for k in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for k in rng.sample(range(words), changed):
            w[k] = f"x{rng.randrange(10**9)}"
        out.append((first + i, " ".join(w), "a"))
    return out


def test_edges(docs, empty):  # noqa: F811
    rows = rows_of(docs)
    expected = brute.near([r for n, r in enumerate(rows) if r[0] is not None and r not in rows[:n]])
    got = minhash.near_duplicates(docs, size=3, least=85).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["id"] is None or ((r["n_shingles"], r["component_id"]) == expected[r["id"]] and r["kept"] == (r["id"] == r["component_id"]))
    assert [(r["n_shingles"], r["component_id"], r["kept"]) for r in got if r["id"] is None] == [(1, None, True)]
    assert minhash.near_duplicates(empty).count() == 0


def test_a_chain(spark):
    base = [f"w{k}" for k in range(120)]
    texts = []
    for i in range(12):  # each differs from the next by one word, ends are far apart
        texts.append((i, " ".join(base), "a"))
        base = [*base[:i * 9], f"n{i}", *base[i * 9 + 1 :]]
    assert found(table(spark, texts)) == brute.near([(i, t) for i, t, _ in texts])


@pytest.mark.parametrize("partitions", ["1", "200"])
def test_one_near_pair_among_clean_texts(spark, partitions):
    rng = random.Random(5)
    texts = [(i, " ".join(f"c{rng.randrange(10**6)}" for _ in range(80)), "a") for i in range(20)] + variants(2, 100, 1, 9, 20)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert found(table(spark, texts)) == brute.near([(i, t) for i, t, _ in texts])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize(("changed", "block"), [(3, 500_000), (4, 500_000), (4, 30_000), (5, 20_000), (2, 10_000)])
def test_a_dense_region_at_the_threshold(spark, changed, block):
    texts = variants(600, 200, changed, 1) + variants(60, 150, 2, 2, 1000)
    expected = brute.near([(i, t) for i, t, _ in texts])
    assert 1 < len({c for _, c in expected.values()})
    assert found(table(spark, texts), block=block) == expected


def test_most_links_at_the_threshold_are_candidates():
    """Recall by pair: of pairs between 85 and 87 %, those that share a region and agree in enough values."""
    rng = np.random.default_rng(3)
    hit = []
    for _ in range(400):
        both, own = 850 + int(rng.integers(0, 20)), 150
        s = rng.integers(0, 1 << 63, both + own, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, both + own, dtype=np.uint64)
        a, b = minhash.sketch(np.sort(s[: both + own // 2])), minhash.sketch(np.sort(np.concatenate((s[:both], s[both + own // 2 :]))))
        same = (a.reshape(-1, minhash.BAND) == b.reshape(-1, minhash.BAND)).all(axis=1).any()
        hit.append(same and (a.astype(np.uint8) == b.astype(np.uint8)).sum() >= 88)
    assert np.mean(hit) > 0.99


def test_links_join_components_only():
    sets = [np.arange(k, k + 100, dtype=np.uint64).tobytes() for k in (0, 1, 2, 500)]
    assert minhash.links(sets, np.arange(4), np.ones(4, bool), 85) == [(0, 1), (0, 2)]
    assert minhash.links(sets, np.array([0, 0, 1, 2]), np.ones(4, bool), 85) == [(0, 2)]


def test_ids_of_other_types_and_repeats(spark):
    texts = variants(4, 120, 1, 7)
    df = table(spark, texts + texts[:1] + [(None, texts[0][1], "a")] * 2).withColumn("doc_id", F.col("doc_id").cast("smallint"))
    got = minhash.near_duplicates(df, size=3, least=85).collect()
    assert len(got) == 7 and {r["component_id"] for r in got} == {0} and sum(r["kept"] for r in got) == 2
