"""Event clusters: gap-and-island sessions, and the ordered stateful assignment by similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.lexicon import COMPATIBLE

HOURS = 72


def sessions(events: DataFrame, keys: list[str], ts: str, seq: str, hours: float = HOURS) -> DataFrame:
    """Adds cluster (number inside the key) and novelty (1/k for the k-th member): a gap above ``hours`` opens a cluster."""
    w = Window.partitionBy(*keys).orderBy(ts, seq)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.lag(F.unix_micros(F.col(ts).cast("timestamp"))).over(w)
    new = F.when(gap.isNull() | (gap > int(hours * 3_600_000_000)), 1).otherwise(0)
    rows = events.withColumn("__new", new).withColumn("cluster", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    k = F.row_number().over(Window.partitionBy(*keys, "cluster").orderBy(ts, seq))
    return rows.withColumn("novelty", 1.0 / k).drop("__new")


def canonical(rows: DataFrame, keys: list[str], score: str, sentiment: str, ts: str, seq: str) -> DataFrame:
    """One row a cluster: counts, bounds, and the row with the highest score (the earliest of equals)."""
    best = F.struct(F.col(score), -F.col(seq))
    return rows.groupBy(*keys, "cluster").agg(
        F.count("*").alias("observation_count"), F.max(score).alias("impact_score"), F.sum(F.col(sentiment).cast("decimal(18,4)")).cast("double").alias("sentiment_sum"),
        F.max_by(seq, best).alias("representative_id"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.min("novelty").alias("novelty"),
    )


def canonical_records(rows: DataFrame, keys: list[str], seq: str, columns: dict[str, str], credit: str = "Credit Event") -> DataFrame:
    """One record a cluster, in full.  ``columns`` names the columns of rows for: impact, sentiment, confidence, source,
    text, event_type, tier, novelty, ts and guard.

    The row with the largest impact speaks for the cluster, the first of equals; sentiment is the mean and confidence
    the largest; sources are distinct; the rows' numbers and the hashes of their texts stand in the order of ``seq``.  The
    guard's reason is there for credit events only.  A record holds its cluster's numbers, which a window bounds."""
    c = {name: F.col(column) for name, column in columns.items()}
    first = F.struct(c["impact"], -F.col(seq))
    speaks = F.max_by(F.struct(*[c[k].alias(k) for k in ("event_type", "tier", "novelty", "ts", "text", "guard")], F.col(seq).alias("seq")), first)
    rows_ = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("seq"), F.md5(F.coalesce(c["text"], F.lit(""))).alias("hash"))))
    g = rows.groupBy(*keys).agg(
        F.count("*").alias("observation_count"), F.max(c["impact"]).alias("impact_score"), F.avg(c["sentiment"]).alias("sentiment_score"), F.max(c["confidence"]).alias("event_confidence"),
        F.array_sort(F.collect_set(c["source"])).alias("source_types"), speaks.alias("rep"), rows_.alias("rows"),
    )
    guard = F.when(F.col("rep.event_type") == credit, F.coalesce("rep.guard", F.lit("")))
    return g.select(
        *keys, "observation_count", "impact_score", "sentiment_score", "event_confidence", "source_types", F.col("rep.event_type").alias("event_type"), F.col("rep.tier").alias("impact_tier"), F.col("rep.novelty").alias("novelty"), F.col("rep.ts").alias("timestamp"),
        F.col("rep.seq").alias("representative_id"), F.col("rep.text").alias("representative_text"), guard.alias("credit_guard_reason"), F.transform("rows", lambda r: r["seq"]).alias("source_row_ids"), F.transform("rows", lambda r: r["hash"]).alias("source_hashes"),
    )


def compatible(a: str | None, b: str | None) -> bool:
    """Rows without a type go with none."""
    return a is not None and (a == b or b in COMPATIBLE.get(a, ()) or a in COMPATIBLE.get(b, ()))


def _sum(a: np.ndarray) -> np.ndarray:
    """The sum of each row, from left to right."""
    return np.add.accumulate(a, axis=1)[:, -1] if a.shape[1] else np.zeros(len(a))


class OpenClusters:
    """The clusters of one entity that a later row can still join, oldest first. Times are microseconds.

    ``unit``: the vectors have length one as they come and are not scaled again, since that moves last digits, which decide
    between clusters that are equally near.  Products are summed one after another for the same reason."""

    def __init__(self, least: float, hours: float, rows: list[dict] | None = None, unit: bool = False):
        self.least, self.span, self.rows, self.unit, self._touched = least, int(hours * 3_600_000_000), rows or [], unit, {}

    def add(self, seq: int, us: int, kind: str, vector: np.ndarray) -> tuple[int, float]:
        """(cluster_id, novelty) of the next row to come. Its time may lie before that of rows that came earlier."""
        v = vector if self.unit else vector / (np.linalg.norm(vector) or 1.0)
        fit = [c for c in self.rows if abs(us - c["latest"]) <= self.span and len(c["sum"]) == len(v) and compatible(c["kind"], kind)]
        if fit:
            sums = np.stack([c["sum"] for c in fit])
            length = np.sqrt(_sum(sums * sums))
            cosine = _sum(sums * v) / np.where(length > 0, length, 1.0)
            cosine[np.isnan(cosine)] = -np.inf  # a vector with a missing number is near to none
            k = int(np.argmax(cosine))  # the oldest of equals
            if cosine[k] >= self.least:
                c = fit[k]
                c["sum"], c["n"], c["latest"] = c["sum"] + v, c["n"] + 1, max(c["latest"], us)
                self._touched[c["name"]] = c
                return c["name"], 1.0 / c["n"]
        self.rows.append({"name": seq, "sum": v, "n": 1, "kind": kind, "latest": us})
        self._touched[seq] = self.rows[-1]
        return seq, 1.0

    def forget(self, us: int) -> None:
        """Drop the clusters that no row at this time or later can join."""
        self.rows = [c for c in self.rows if us - c["latest"] <= self.span]

    def touched(self) -> list[dict]:
        return list(self._touched.values())


def _assign(least: float, hours: float, unit: bool):
    """Sorted rows of many groups pass by; only the open clusters of the present one are held."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        present, state = None, None
        for frame in frames:
            out = []
            for entity, part, seq, ts, kind, vector in zip(frame["entity"], frame["part"], frame["seq"], frame["ts"].to_numpy("datetime64[us]").astype(np.int64).tolist(), frame["event_type"], frame["vector"], strict=True):
                if state is None or (entity, part) != present:
                    present, state = (entity, part), OpenClusters(least, hours, unit=unit)
                state.forget(ts)  # rows come by time
                out.append(state.add(seq, ts, kind, np.asarray(vector, float)))
            yield pd.DataFrame({"entity": frame["entity"], "seq": frame["seq"], "cluster_id": [c for c, _ in out], "novelty": [n for _, n in out]})

    return run


def assign(rows: DataFrame, least: float = 0.85, hours: float = HOURS, unit: bool = False) -> DataFrame:
    """rows: entity, seq, ts, event_type, vector.  Each row joins the most similar open cluster of its entity, or opens one.

    Rows come in the order of ts, then seq (null entities are one entity; ts is never null).  No cluster outlives a gap
    above ``hours``, so an entity is cut at its gaps and the pieces run apart; a task streams its sorted rows and holds
    the clusters of one window.  cluster_id is the seq of the cluster's first row.
    ``unit``: the vectors have length one and are taken as they are."""
    cut = sessions(rows.select("entity", "seq", "ts", "event_type", "vector"), ["entity"], "ts", "seq", hours).withColumnRenamed("cluster", "part")
    ordered = cut.repartition("entity", "part").sortWithinPartitions("entity", "part", "ts", "seq").select("entity", "part", "seq", "ts", "event_type", "vector")
    return ordered.mapInPandas(_assign(least, hours, unit), "entity string, seq long, cluster_id long, novelty double")


def nearest(rows: DataFrame, hours: float = HOURS) -> DataFrame:
    """rows: id, entity, ts, vector.  For each row id, near_id and cosine of the most similar other row of its entity that
    is at most ``hours`` away (the smallest id of equals); rows without any are left out.

    An equi-join on entity and time bucket, so pairs grow with the rows of a window, not with those of an entity."""
    width = int(hours * 3_600_000_000)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    r = rows.select("id", "entity", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.transform("vector", lambda x: x.cast("double")).alias("v"))
    r = r.withColumn("norm", F.sqrt(dot(F.col("v"), F.col("v")))).withColumn("slot", F.floor(F.col("us") / width))
    other = r.select("entity", F.explode(F.array(F.col("slot") - 1, F.col("slot"), F.col("slot") + 1)).alias("slot"), F.col("id").alias("near_id"), F.col("us").alias("us2"), F.col("v").alias("w"), F.col("norm").alias("norm2"))
    pairs = r.join(other, ["entity", "slot"]).filter((F.col("id") != F.col("near_id")) & (F.abs(F.col("us") - F.col("us2")) <= width))
    scored = pairs.select("id", "near_id", F.try_divide(dot(F.col("v"), F.col("w")), F.col("norm") * F.col("norm2")).alias("cosine"))
    best = scored.groupBy("id").agg(F.max_by(F.struct("near_id", "cosine"), F.struct("cosine", -F.col("near_id"))).alias("b"))
    return best.select("id", "b.near_id", "b.cosine")
