"""Tail probabilities, the vector index and the profile against plain versions."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.operators import evaluate, profile, vectors


def simpson(rho, n):
    """The two-sided tail of Student's t as an integral of a power of the cosine."""
    df, steps = n - 2, 40_000
    lo = math.atan(abs(rho) / math.sqrt(1 - rho * rho))
    h = (math.pi / 2 - lo) / steps
    u = lo + h * np.arange(steps + 1)
    w = np.where(np.arange(steps + 1) % 2, 4.0, 2.0)
    w[[0, -1]] = 1
    return 2 * h / 3 * (w * np.cos(u).clip(0) ** (df - 1)).sum() * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)


def test_p_of_a_correlation(spark):
    rows = [(r, n) for n in (5, 6, 7, 10, 20, 101, 1000, 5000) for r in (0.001, 0.05, -0.2, 0.5, 0.77, -0.9, 0.999)]
    got = spark.createDataFrame(rows, "rho double, n long").select("rho", "n", stats.correlation_p(F.col("rho"), F.col("n")).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(simpson(r.rho, r.n), abs=1e-9), (r.rho, r.n)
    edges = spark.createDataFrame([(0.5, 4), (None, 10), (1.0, 10), (-1.0, 10), (0.0, 10), (float("nan"), 10)], "rho double, n long").select(stats.correlation_p(F.col("rho"), F.col("n")).alias("p")).collect()
    assert [r.p for r in edges] == [None, None, 0.0, 0.0, 1.0, None]
    # Two-sided points of Student's t from its tables (2.086 at 20 degrees is 5 %, 2.845 is 1 %).
    table = [(2.086 / math.sqrt(20 + 2.086**2), 22, 0.05), (2.845 / math.sqrt(20 + 2.845**2), 22, 0.01), (12.706 / math.sqrt(1 + 12.706**2), 3 + 0, None)]
    got = spark.createDataFrame(table, "rho double, n long, want double").select("want", stats.correlation_p(F.col("rho"), F.col("n")).alias("p")).collect()
    assert got[0].p == pytest.approx(0.05, abs=2e-5) and got[1].p == pytest.approx(0.01, abs=1e-5) and got[2].p is None
    big = spark.createDataFrame([(0.002, 1_000_000)], "rho double, n long").select(stats.correlation_p(F.col("rho"), F.col("n")).alias("p")).first().p
    assert big == pytest.approx(math.erfc(0.002 * math.sqrt(1e6) / math.sqrt(2)), abs=1e-6)


def test_few_rows_have_no_correlation(spark):
    df = spark.createDataFrame([("a", float(k), float(k * k - 30)) for k in range(12)] + [("b", 1.0, 2.0)] * 4 + [("a", None, 1.0)], "g string, x double, y double")
    got = {r.g: r for r in evaluate.rank_correlations(df, ["g"], "x", "y").collect()}
    assert got["a"].n == 12 and got["a"].rho_signed == pytest.approx(1.0) and got["a"].rho_abs < 1 and got["a"].p_abs > 0
    assert tuple(got["b"])[1:] == (4, None, None, None, None)


def test_horizons(spark):
    rows = [("a", 1.0, None), ("a", -3.0, None), ("a", 0.5, None), ("b", None, 2.0)]
    got = {(r.g, r.horizon): tuple(r)[2:] for r in evaluate.horizon_stats(spark.createDataFrame(rows, "g string, d1 double, d7 double"), ["g"], ["d1", "d7"]).collect()}
    assert got[("a", "d1")] == (3, 3, -0.5, 0.5, 1.5, 1.0) and got[("a", "d7")] == (3, 0, None, None, None, None)
    assert got[("b", "d1")] == (1, 0, None, None, None, None) and got[("b", "d7")] == (1, 1, 2.0, 2.0, 2.0, 2.0)


def brute(x, q, k):
    out = []
    for i, row in enumerate(q):
        s = x @ row
        out += [(i, int(j)) for j in sorted(range(len(x)), key=lambda j: (-s[j], j))[:k]]
    return sorted(out)


@pytest.mark.parametrize(("clusters", "share"), [(40, 0.1), (0, 1.0)])
def test_nearest_vectors(spark, clusters, share):
    """Exact on clustered rows, where at most a tenth of all pairs is looked at, and on rows without structure."""
    rng = np.random.default_rng(2)
    n, d, k = 3000, 12, 7
    x = rng.normal(size=(n, d))
    if clusters:
        x = 4 * rng.normal(size=(clusters, d))[rng.integers(clusters, size=n)] + 0.25 * x
    q = x[::150] + 0.1 * rng.normal(size=(20, d))
    frame = lambda a: spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(a)], "id long, v array<double>")
    index = vectors.build(frame(x), "id", "v", cells=100)
    got = vectors.search(index, frame(q), "id", "v", k).collect()
    assert sorted((r.query, r.id) for r in got) == brute(x, q, k)
    assert all(r.score == pytest.approx(float(x[r.id] @ q[r.query])) for r in got)
    first, second = vectors.looked_at(index, frame(q), "id", "v", k)

    assert first.count() + second.count() <= share * n * len(q)


def test_edges_of_the_index(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0])], "id int, v array<float>")
    got = vectors.search(vectors.build(df, "id", "v"), df, "id", "v", 2).collect()
    assert sorted((r.query, r.id, r.rank) for r in got) == [(1, 1, 1), (1, 2, 2), (2, 1, 1), (2, 2, 2), (4, 1, 1), (4, 2, 2)]
    assert vectors.search(vectors.build(df.limit(0), "id", "v"), df, "id", "v", 2).count() == 0
    assert vectors.search(vectors.build(df, "id", "v"), df.limit(0), "id", "v", 2).count() == 0


def test_retrieval_filters_the_nearest(spark):
    day = dt.datetime(2024, 1, 1)
    c = [(k, "e" if k % 2 else "f", "Credit Event", day + dt.timedelta(hours=40 * k), [float(np.cos(k / 9)), float(np.sin(k / 9))]) for k in range(8)]
    asked = [(1, "e", "Credit Event", day + dt.timedelta(hours=90), [1.0, 0.0]), (2, "e", "Macroeconomic", day, [1.0, 0.0]), (3, "f", "Credit Event", day + dt.timedelta(days=60), [1.0, 0.0])]
    clusters = spark.createDataFrame(c, "cluster long, entity string, event_type string, updated_at timestamp, centroid array<double>")
    got = vectors.retrieve(clusters, spark.createDataFrame(asked, "id long, entity string, event_type string, ts timestamp, vector array<double>"), k=50)
    assert [(r.id, r.cluster) for r in got.collect()] == [(1, 1)]
    only = vectors.retrieve(clusters, spark.createDataFrame(asked, "id long, entity string, event_type string, ts timestamp, vector array<double>"), k=1)
    assert only.count() == 0  # the nearest of all is of another entity


def test_profile(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate((rng.normal(size=500) * 1000, [0.0, -5.25]))
    rows = [(float(v), None if k % 7 == 0 else int(k), f"s{k}" if k % 3 else None, [1] if k % 2 else None) for k, v in enumerate(x)] + [(float("nan"), 1, "t", None)]
    got = {r.column: r for r in profile.profile(spark.createDataFrame(rows, "x double, k int, s string, a array<int>")).collect()}
    r, kept = got["x"], np.round(x, 4)
    assert (r.n, r.n_null) == (503, 1) and r.low == kept.min() and r.high == kept.max()
    assert r["mean"] == pytest.approx(kept.mean()) and r["std"] == pytest.approx(kept.std(ddof=1))
    for name, q in profile.QUANTILES.items():
        true = np.sort(kept)[max(math.ceil(q * len(kept)), 1) - 1]
        assert abs(r[name] - true) <= 0.01 * abs(true) + 1e-9
    assert (got["s"].n, got["s"].n_null, got["s"].low, got["s"].p50) == (503, 168, None, None) and got["a"].n_null == 252
    assert profile.profile(spark.createDataFrame([], "x double")).count() == 0
    plan = profile.profile(spark.range(5))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range") - plan.count("RangePartitioning") == 1
