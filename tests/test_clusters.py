"""Ordered clusters, nearest rows, first matches, bucket edges and sinks against plain versions."""

import datetime as dt
import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import lexicon as X
from tidemark.functions.text import first_match
from tidemark.operators import clustering, evaluate
from tidemark.sources import sinks


def _rows(n=160, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, 6))
    start = dt.datetime(2024, 1, 1)
    kinds = ["Credit Event", "Macroeconomic", "Merger & Acquisition"]
    out, at = [], start
    for k in range(n):
        at += dt.timedelta(hours=float(rng.choice([0, 3, 20, 90], p=[0.2, 0.5, 0.25, 0.05])))
        v = centres[rng.integers(4)] + rng.normal(size=6) * 0.4
        out.append((["a", "b", None][rng.integers(3)], k, at, kinds[rng.integers(3)], [float(x) for x in v]))
    return out


def _plain(rows, least, hours):
    """Every row against every cluster ever opened, in order."""
    clusters, out = [], {}
    for entity, seq, ts, kind, vector in sorted(rows, key=lambda r: (r[2], r[1])):
        v = np.asarray(vector) / np.linalg.norm(vector)
        best = None
        for c in clusters:
            if c["entity"] == entity and clustering.compatible(c["kind"], kind) and (ts - c["latest"]).total_seconds() <= hours * 3600:
                s = float(c["sum"] @ v / np.linalg.norm(c["sum"]))
                if s >= least and (best is None or s > best[0]):
                    best = (s, c)
        if best:
            c = best[1]
            c["n"] += 1
            c["sum"], c["latest"] = c["sum"] + v, ts
        else:
            c = {"entity": entity, "kind": kind, "sum": v, "latest": ts, "n": 1, "name": seq}
            clusters.append(c)
        out[seq] = (c["name"], 1.0 / c["n"])
    return out


SCHEMA = "entity string, seq long, ts timestamp, event_type string, vector array<double>"


@pytest.mark.parametrize("least", [0.6, 0.85])
def test_ordered_assignment(spark, least):
    rows = _rows()
    got = {r.seq: (r.cluster_id, r.novelty) for r in clustering.assign(spark.createDataFrame(rows, SCHEMA), least).collect()}
    assert got == _plain(rows, least, 72)
    assert len({c for c, _ in got.values()}) < len(rows)


def test_ordered_assignment_of_nothing(spark):
    assert clustering.assign(spark.createDataFrame([], SCHEMA)).collect() == []


def test_nearest_in_a_window(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("seq", "id")
    want = {}
    for e, k, ts, _, v in rows:
        near = [(-np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w)), j) for f, j, t, _, w in rows if e is not None and f == e and j != k and abs((t - ts).total_seconds()) <= 72 * 3600]
        if near:
            want[k] = min(near)[1]
    assert {r.id: r.near_id for r in clustering.nearest(df).collect()} == want and want


def test_first_match_takes_the_first_pattern_of_the_list(spark):
    texts = ["Acme filed for bankruptcy", "shares plunged after the outage", "debt restructuring and default on a $5 loan", "Oracle buys Apiary", "", "nothing"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(1)
    for patterns in X.RULES.values():
        want = []
        for t in texts:
            hits = [m.group(0) for m in (re.search(p, t, re.I) for p in patterns) if m and m.group(0)]
            want.append(hits[0] if hits else None)
        got = {r.t: r.h for r in df.select("t", first_match(F.col("t"), patterns).alias("h")).collect()}
        assert [got[t] for t in texts] == want


def test_bucket_edges(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 1, 1, 2, 3, 4, 5, 6, 7, 50]], "x double")
    got = sorted((r.x, r.bucket) for r in evaluate.quantile_buckets(df, "x", 5).collect())
    edges = np.quantile([x for x, _ in got], [0.2, 0.4, 0.6, 0.8])
    inner = sorted({e for e in edges if e > 1.0})
    assert got == [(x, sum(e < x for e in inner)) for x, _ in got]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a|b", 2.5), (2, None, 3.0)], "id long, name string, x double")
    sinks.json_lines(rows, str(tmp_path / "j"))
    sinks.json_lines(rows, str(tmp_path / "j"))  # replaced as a whole
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert {json.loads(line)["id"] for f in (tmp_path / "j").glob("part-*") for line in f.read_text().splitlines()} == {1, 2}
    sinks.append_csv(rows, str(tmp_path / "c"))
    sinks.append_csv(rows, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 4
    sinks.parquet(rows.withColumn("d", F.lit("x")), str(tmp_path / "p"), by=["d"])
    assert spark.read.parquet(str(tmp_path / "p")).filter("d = 'x'").count() == 2
    text = sinks.report("Scores", {"Rows": rows}).first().report
    assert text.splitlines() == ["# Scores", "", "## Rows", "", "| id | name | x |", "|-|-|-|", "| 1 | a\\|b | 2.5 |", "| 2 |  | 3.0 |"]
    assert sinks.report("None", {"Rows": rows.limit(0)}).first().report.endswith("|-|-|-|")
