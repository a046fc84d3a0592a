"""Event clusters in the order of arrival, as a stream.

Each row joins the most similar open cluster of its entity, or opens one.  A cluster is open to a row whose type fits
and whose time is within the window of the cluster's latest time, before or after it, so a late row joins too; the
latest time only grows.  The state of an entity is its open clusters; a timer removes a cluster once the watermark has
passed its latest time by the window, since no row that still comes can be near enough.

Defined cases: null entities are one entity; rows of one batch are taken by ``seq``, the number of their arrival, and a
cluster is named by the seq of its first row, so that names tell their age; rows without time or vector are left out;
vectors of other lengths are never similar; rows older than the watermark are dropped by it; equal similarities go to
the oldest cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.clustering import HOURS, OpenClusters

OUT = "entity string, seq long, cluster_id long, novelty double"


class Clusterer(StatefulProcessor):
    def __init__(self, least: float, hours: float):
        self.least, self.hours = least, hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clusters = handle.getMapState("clusters", "name long", "total binary, n long, kind string, latest long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        frame = pd.concat(list(rows)).sort_values("seq", kind="stable")  # the rows of one entity in one batch
        held = [{"name": k[0], "sum": np.frombuffer(v[0]), "n": v[1], "kind": v[2], "latest": v[3]} for k, v in (self.clusters.iterator() if self.clusters.exists() else ())]
        state = OpenClusters(self.least, self.hours, sorted(held, key=lambda c: c["name"]))
        out = [state.add(*row) for row in zip(frame["seq"], frame["us"], frame["event_type"], (np.asarray(v, float) for v in frame["vector"]), strict=True)]
        for c in state.touched():
            self.clusters.updateValue((int(c["name"]),), (c["sum"].tobytes(), int(c["n"]), c["kind"], int(c["latest"])))
            self.handle.registerTimer(c["latest"] // 1000 + int(self.hours * 3_600_000) + 1)
        yield pd.DataFrame({"entity": [key[0]] * len(frame), "seq": frame["seq"].to_numpy(), "cluster_id": [c for c, _ in out], "novelty": [n for _, n in out]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        now = expiredTimerInfo.getExpiryTimeInMs()
        span = int(self.hours * 3_600_000)
        for name, value in list(self.clusters.iterator()):
            if value[3] // 1000 + span < now:
                self.clusters.removeKey(name)
        yield from ()

    def close(self) -> None:
        pass


def assigned(stream: DataFrame, least: float = 0.85, hours: float = HOURS, late: str = "72 hours") -> DataFrame:
    """stream: entity, seq, ts, event_type, vector.  entity, seq, cluster_id (the seq of its first row) and novelty (1/k
    for the k-th to come); rows may be as late as ``late``.

    The session needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``)."""
    rows = stream.filter("ts is not null and vector is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = rows.select("entity", "seq", "ts", F.unix_micros("ts").alias("us"), "event_type", "vector")
    return rows.groupBy("entity").transformWithStateInPandas(Clusterer(least, hours), OUT, "Append", "EventTime")
