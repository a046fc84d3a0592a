"""Vector search in blocks: many groups of cells and queries, copies of vectors, ids of text."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import vectors


def summed(q, x):
    """Inner products, one product after another."""
    s = np.zeros(len(x))
    for d in range(x.shape[1]):
        s += q[d] * x[:, d]
    return s


@pytest.mark.parametrize(("rows", "queries", "piece"), [(65_536, 8_192, 100_000), (150, 8, 40)])
def test_blocks_are_exact(spark, monkeypatch, rows, queries, piece):
    """F7, F8: pairs are compared as products of matrices, not as rows of a join; copies tie and go by id, whatever their block."""
    for name, value in (("ROWS", rows), ("QUERIES", queries), ("PIECE", piece)):
        monkeypatch.setattr(vectors, name, value)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 13))
    x = np.concatenate((x, x, np.repeat(x[7:8], 600, axis=0)))[rng.permutation(1200)]  # one very common vector
    ids, q, k = [f"r{i:05d}" for i in rng.permutation(len(x))], x[::40], 9
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "id string, v array<double>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "id long, v array<double>")
    out = vectors.search(vectors.build(df, "id", "v", cells=20), asked, "id", "v", k)
    got = sorted((r.query, r["rank"], r.id, r.score) for r in out.collect())
    want = []
    for n, row in enumerate(q):
        s = summed(row, x)
        want += [(n, place + 1, ids[j], s[j]) for place, j in enumerate(sorted(range(len(x)), key=lambda j: (-s[j], ids[j]))[:k])]
    assert got == want
    assert "zip_with" not in out._jdf.queryExecution().toString()
    few = vectors.search(vectors.build(df.limit(3), "id", "v"), asked, "id", "v", k)
    assert few.groupBy("query").agg(F.count("*").alias("n")).filter("n <> 3").count() == 0 and few.count() == 3 * len(q)
