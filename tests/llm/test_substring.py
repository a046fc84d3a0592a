"""Substring dedup against brute force where factors meet, overlap and repeat."""

import random

from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.test_operators import plain, rows_of, table
from tidemark.llm import substring


def check(df):
    got = plain(substring.dedup(df).withColumn("h", F.sha2(F.col("kept_text").cast("binary"), 256)), "id", "n_words", "n_removed", "h")
    assert got == sorted(brute.substring(rows_of(df)), key=repr)


def test_overlapping_passages(spark):
    rng = random.Random(1)
    source = [f"s{k}" for k in range(400)]
    texts = []
    for i in range(120):
        w = [f"own{i}x{k}" for k in range(rng.randrange(30))]
        for _ in range(rng.randrange(4)):
            a = rng.randrange(360)
            w += source[a : a + rng.randrange(20, 90)] + [f"own{i}y{rng.randrange(10**6)}" for _ in range(rng.randrange(3))]
        texts.append((i, " ".join(w), "a"))
    check(table(spark, texts))


def test_repetitive_texts(spark):
    texts = [(1, "a " * 300, "a"), (2, "a b " * 200, "a"), (3, "x " + "a b " * 17 + "y", "a"), (4, "a " * 35, "a"), (5, "c d e f " * 9, "a"), (6, " ".join(f"q{k}" for k in range(35)), "a")]
    check(table(spark, texts))


def test_ids_repeats_and_clashing_names(spark):
    text = " ".join(f"q{k}" for k in range(60))
    df = table(spark, [(1, text, "a"), (1, text, "a"), (2, text[4:] + " end", "b"), (None, text, "a"), (None, "z " + text, "a"), (3, "", "a"), (4, None, "a")])
    check(df.withColumn("kept_text", F.lit("clash")).withColumn("marks", F.lit(1)))
    got = substring.dedup(df.withColumn("doc_id", F.col("doc_id").cast("smallint")))
    assert got.schema["id"].dataType.simpleString() == "smallint" and got.count() == 7


def test_a_very_long_text(spark):
    rng = random.Random(2)
    words = [f"l{rng.randrange(5000)}" for _ in range(300_000)]
    df = table(spark, [(1, " ".join(words), "a"), (2, " ".join(words[1000:1100]), "a"), (3, " ".join(words[250_000:250_030]), "a")])
    got = {r["id"]: r["n_removed"] for r in substring.dedup(df).collect()}
    assert got == {1: 100, 2: 100, 3: 0}


def test_a_parse_follows_the_reference_that_goes_further():
    far, near = 64 * 7, 64 * 9
    assert substring.parse([(0, near, far), (1, far + 1, far + 1), (2, far + 2, far + 2), (4, near, near)], 64 * 50) == [(0, 3, far), (4, 1, near)]
    assert substring.parse([(3, 64 * 50 + 3, far)], 64 * 50) == [(3, 1, far)]


def test_factors_name_their_references(spark):
    source = [f"s{k}" for k in range(200)]
    df = table(spark, [(1, " ".join(source), "a"), (2, " ".join(["o"] * 3 + source[40:140] + ["p"] * 3), "a")])
    by_id = {r["id"]: r["factors"] for r in substring.dedup(df).collect()}
    assert [(f["start"], f["end"]) for f in by_id[1]][:1] == [(40, 140)] or {(f["ref_id"], f["ref_start"] - f["start"]) for f in by_id[1]} == {(2, -37)}
    assert {(f["ref_id"], f["ref_start"] - f["start"]) for f in by_id[2]} == {(1, 37)}
    assert min(f["start"] for f in by_id[2]) == 3 and max(f["end"] for f in by_id[2]) == 103
