"""Fill-in-the-middle against a version with regular expressions and slices."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.test_operators import docs, empty, rows_of, table  # noqa: F401
from tidemark.llm import middle


def plain_version(i, text, seed=7, rate=100, spm=50, pattern=r"[^\n]*\n|[^\n]+"):
    text = text or ""
    units = re.findall(pattern, text, re.S)
    digest = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@settings(max_examples=400, deadline=None)
@given(st.text("ab\n\r<>PSM é日\U0001f600 ", max_size=60), st.integers(0, 10**6))
def test_one_text(text, i):
    for rate, spm in ((100, 50), (50, 0), (0, 100)):
        n, form, before, mid, out = middle.transform(text.encode(), i, 7, rate, spm, "line")
        assert (n, form, before, mid, out.decode()) == plain_version(i, text, 7, rate, spm)
    n, form, before, mid, out = middle.transform(text.encode(), i, 3, 100, 50, "char")
    assert (n, form, before, mid, out.decode()) == plain_version(i, text, 3, pattern=".")


@given(st.integers(1, 1 << 300))
def test_select(bits):
    places = [k for k in range(bits.bit_length()) if bits >> k & 1]
    assert [middle.select(bits, r) for r in range(len(places))] == places


def test_table(docs, empty, spark):  # noqa: F811
    more = [(50 + k, t, "a") for k, t in enumerate(["\n", "\n\n\n", "a\nb\n", "a\r\nb", "x <P> y\nz", "<\nP>\n<S\n>", "日本\n語\n" * 50, "line of text\n" * 200_000])]
    every = docs.unionByName(table(spark, more))
    got = middle.fill_in_middle(every)
    got = got.withColumn("back", middle.restored(F.col("output"), F.col("form"))).collect()
    rows = rows_of(every)
    assert sorted((repr((r["id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"])) for r in got)) == sorted(repr((i, *plain_version(i, t))) for i, t in rows)
    assert sorted((repr((r["id"], r["back"])) for r in got)) == sorted(repr((i, t or "")) for i, t in rows)
    assert {"plain", "psm", "spm"} == {r["form"] for r in got}
    assert middle.fill_in_middle(empty).count() == 0
    small = middle.fill_in_middle(docs.withColumn("doc_id", F.col("doc_id").cast("smallint")).withColumn("output", F.lit("clash")))
    assert small.schema["id"].dataType.simpleString() == "smallint"
    with pytest.raises(ValueError, match="unit"):
        middle.fill_in_middle(docs, unit="word")
