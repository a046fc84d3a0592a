"""Clusters in the order of arrival against a plain loop, over shuffled orders and many batches."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_clusters import SCHEMA, _rows
from tidemark.functions import lexicon as X
from tidemark.streaming import clusters

FITS = {frozenset((a, b)) for a, many in X.COMPATIBLE.items() for b in many}


def plain(rows, least, hours=72):
    """Each row against all clusters so far, in the order of arrival; the latest time of a cluster only grows."""
    found, out = [], {}
    for entity, seq, ts, kind, vector in rows:
        v = np.asarray(vector) / np.linalg.norm(vector)
        best = None
        for c in found:
            near = abs((ts - c["latest"]).total_seconds()) <= hours * 3600
            if c["entity"] == entity and near and (c["kind"] == kind or frozenset((c["kind"], kind)) in FITS):
                s = float(c["sum"] @ v / np.linalg.norm(c["sum"]))
                if s >= least and (best is None or s > best[0]):
                    best = (s, c)
        if best:
            c = best[1]
            c.update(n=c["n"] + 1, sum=c["sum"] + v, latest=max(c["latest"], ts))
        else:
            c = {"entity": entity, "kind": kind, "sum": v, "latest": ts, "n": 1, "name": seq}
            found.append(c)
        out[seq] = (entity, c["name"], 1.0 / c["n"])
    return out


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set(key, before)
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def run(spark, folder, batches, least, late):
    """Each batch as a file, one a trigger; the stream is stopped and started again half-way."""
    source, got = folder / "in", []
    source.mkdir()
    for half in (batches[: len(batches) // 2], batches[len(batches) // 2 :]):
        for rows in half:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
        q = clusters.assigned(stream, least, late=late).writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(folder / "state")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None
    state = spark.read.format("statestore").option("path", str(folder / "state")).option("stateVarName", "clusters").load().count()
    return got, state


def test_arrival_order(rocks, tmp_path):
    rng = random.Random(5)
    rows = _rows(90, 7)
    line = sorted(rows, key=lambda r: r[2].timestamp() + rng.random() * 60 * 3600)  # up to 60 hours late
    line = [(e, k, ts, kind, v) for k, (e, _, ts, kind, v) in enumerate(line)]
    assert any(a[2] > b[2] for a, b in zip(line, line[1:], strict=False))
    got, state = run(rocks, tmp_path, [line[k : k + 15] for k in range(0, 90, 15)], 0.6, "300 days")
    want = plain(line, 0.6)
    assert {r.seq: (r.entity, r.cluster_id, r.novelty) for r in got} == want
    assert len({c for _, c, _ in want.values()}) < 80 and state == len({c for _, c, _ in want.values()})


def test_state_is_bounded_by_the_watermark(rocks, tmp_path):
    start = dt.datetime(2024, 1, 1)
    v = [[1.0, 0.0], [0.0, 1.0]]
    rows = [("e", k, start + dt.timedelta(hours=40 * k), "Credit Event", v[k % 2]) for k in range(24)]
    got, state = run(rocks, tmp_path, [rows[k : k + 4] for k in range(0, 24, 4)], 0.85, "1 hour")
    assert {r.seq: (r.entity, r.cluster_id, r.novelty) for r in got} == plain(rows, 0.85)
    assert len({r.cluster_id for r in got}) == 24 and state <= 8  # two of each batch of four are near the watermark
