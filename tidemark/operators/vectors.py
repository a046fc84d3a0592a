"""Exact nearest vectors by inner product, with an index that proves which cells can't win.

Rows are put into cells around sampled centres.  For a query q and a row x of a cell with centre c,
q.x = q.c + q.(x - c) <= q.c + |q| |x - c|, so a cell's radius bounds all its rows and a row's own distance bounds the
row.  A query first looks into the cell of its best centre and into the next ones until these hold k rows; the k-th
best of them is a floor, and only cells and rows whose bound reaches it are looked at after that.  What is left out
can't be among the k best.

How much is left out depends on the data: rows that lie in clusters are skipped but for a few cells; vectors without any
structure in many dimensions have no near ones, and then all pairs of queries and rows are compared.

Pairs are compared in blocks: cells are dealt into groups of some ``ROWS`` rows and queries into groups of some
``QUERIES``; a task holds the queries of one pair of groups and streams its rows past them, as products of matrices.
Those choose candidates only.  What is returned is summed one product after another, as SQL does, so that ties stay ties.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import stored

#: Centres at most; they are broadcast (CELLS * dimensions * 8 bytes).
CELLS = 256
#: Rows of a group of cells, and queries that a task holds (QUERIES * dimensions * 8 bytes), about.
ROWS, QUERIES = 65_536, 8_192
#: Candidates whose scores are summed, and then ranked, at once.
PIECE = 100_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


@dataclass(frozen=True)
class Index:
    """rows: id, v, cell, away (distance to the centre); cells: cell, c, n, radius."""

    rows: DataFrame
    cells: DataFrame


def _place(centres: np.ndarray):
    half = (centres**2).sum(axis=1) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1) if len(v) else np.zeros((0, centres.shape[1]))
            cell = (x @ centres.T - half).argmax(axis=1)  # the nearest centre
            away = np.sqrt(((x - centres[cell]) ** 2).sum(axis=1)) * (1 + 1e-12) + 1e-12  # no smaller than it is
            yield pa.RecordBatch.from_arrays([batch.column("id"), v, pa.array(cell, pa.int32()), pa.array(away)], ["id", "v", "cell", "away"])

    return run


def _bounds(cells: list):
    """Each query with each cell: the inner product with its centre, and how many rows lie in cells of better centres."""
    centres = np.array([r["c"] for r in cells]) if cells else np.zeros((0, 0))
    cell, n, radius = (np.array([r[c] for r in cells]) for c in ("cell", "n", "radius"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not cells:
                continue
            q = batch.column("q").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            near = q @ centres.T
            order = np.argsort(-near, axis=1, kind="stable")
            ahead = np.cumsum(n[order], axis=1) - n[order]
            length = np.sqrt((q * q).sum(axis=1)) * (1 + 1e-12)
            every = pa.array(np.repeat(np.arange(batch.num_rows), len(cells)))
            columns = [batch.column("query").take(every), pa.array(np.repeat(length, len(cells))), pa.array(cell[order].ravel().astype(np.int32)), pa.array(np.take_along_axis(near, order, axis=1).ravel()), pa.array(radius[order].ravel()), pa.array(ahead.ravel().astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["query", "length", "cell", "near", "radius", "ahead"])

    return run


def build(rows: DataFrame, id_col: str, vector: str, cells: int = CELLS, seed: int = 1) -> Index:
    """Rows without a vector are left out; all vectors have one length."""
    v = F.transform(vector, lambda x: x.cast("double"))
    line = rows.filter(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), v.alias("v"))
    some = line.orderBy(F.xxhash64(F.lit(seed), "id")).limit(cells).collect()  # at most ``cells`` rows
    centres = np.array([r["v"] for r in some]) if some else np.zeros((1, 1))
    kind = line.schema["id"].dataType.simpleString()
    placed = stored(line.mapInArrow(_place(centres), f"id {kind}, v array<double>, cell int, away double"))
    named = rows.sparkSession.createDataFrame([(k, [float(x) for x in c]) for k, c in enumerate(centres)], "cell int, c array<double>")
    size = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"))
    return Index(placed, stored(named.join(size, "cell")))  # a row a cell


def _best(scored: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def _bounded(index: Index, queries: DataFrame, id_col: str, vector: str) -> tuple[DataFrame, DataFrame, list]:
    """The queries (query, q), each of them with each cell, and the cells."""
    v = F.transform(vector, lambda x: x.cast("double"))
    asked = stored(queries.filter(F.col(vector).isNotNull()).select(F.col(id_col).alias("query"), v.alias("q")))
    kind = asked.schema["query"].dataType.simpleString()
    cells = index.cells.orderBy("cell").collect()  # CELLS rows at most
    return asked, stored(asked.mapInArrow(_bounds(cells), f"query {kind}, length double, cell int, near double, radius double, ahead long")), cells


def _rest(bounded: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """The cells that a query has not looked into and that may hold one of its best, with its floor (least)."""
    floor = first.groupBy("query").agg(F.count("*").alias("found"), F.min("score").alias("least"))
    floor = floor.select("query", F.when(F.col("found") >= k, F.col("least")).otherwise(F.lit(float("-inf"))).alias("least"))
    slack = F.lit(1e-9)  # bounds and scores are rounded
    return bounded.filter(F.col("ahead") >= k).join(floor, "query").filter(F.col("near") + F.col("length") * F.col("radius") + slack >= F.col("least"))


def looked_at(index: Index, queries: DataFrame, id_col: str, vector: str, k: int) -> tuple[DataFrame, DataFrame]:
    """The pairs (query, id, score) of the first look and those of the second that reach the floor by the row's own bound;
    for small tables, to see what the index leaves out."""
    asked, bounded, _ = _bounded(index, queries, id_col, vector)
    here = index.rows.select("cell", "id", "v", "away")
    score = dot(F.col("q"), F.col("v")).alias("score")
    first = stored(_best(bounded.filter(F.col("ahead") < k).join(asked, "query").join(here, "cell").select("query", "id", score), k).drop("rank"))
    second = _rest(bounded, first, k).join(asked, "query").join(here, "cell").filter(F.col("near") + F.col("length") * F.col("away") + 1e-9 >= F.col("least")).select("query", "id", score)
    return first, second


class _Block:
    """The queries of one pair of groups, and the k best rows of each so far."""

    def __init__(self, k: int):
        self.k, self.parts, self.held, self.found, self.ready = k, [], 0, [], False

    def ask(self, batch: pa.RecordBatch) -> None:
        self.parts.append(batch)

    def _start(self) -> None:
        t = pa.Table.from_batches(self.parts).combine_chunks()
        self.query, self.parts, self.ready = t.column("query").combine_chunks(), [], True
        self.q = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)
        self.length = np.sqrt((self.q * self.q).sum(axis=1))
        self.floor = t.column("least").to_numpy().copy()
        cells = t.column("cells").combine_chunks()
        every = np.repeat(np.arange(len(t)), cells.value_lengths().to_numpy())
        flat = cells.flatten().to_numpy()
        order = np.argsort(flat, kind="stable")
        named, first = np.unique(flat[order], return_index=True)
        self.of = dict(zip(named.tolist(), np.split(every[order], first[1:]), strict=True))

    def look(self, cell: int, ids: pa.Array, x: np.ndarray) -> None:
        """Rows of a cell: those that may be among the best of a query that asks for the cell are scored."""
        if not self.ready:
            self._start()
        asked = self.of.get(cell)
        if asked is None:
            return
        most = np.sqrt((x * x).sum(axis=1).max())
        for at in range(0, len(asked), 512):
            who = asked[at : at + 512]
            s = self.q[who] @ x.T
            slack = 1e-9 + 1e-12 * self.length[who] * most  # more than the rounding of either sum
            hit = s >= (self.floor[who] - slack)[:, None]
            many = np.flatnonzero(hit.sum(axis=1) > 2 * self.k)
            if len(many):  # the k-th best of these rows alone is a floor too
                self.floor[who[many]] = np.maximum(self.floor[who[many]], np.partition(s[many], -self.k, axis=1)[:, -self.k] - slack[many])
                hit[many] = s[many] >= (self.floor[who[many]] - slack[many])[:, None]
            i, j = np.nonzero(hit)
            for k in range(0, len(i), PIECE):
                self._take(who[i[k : k + PIECE]], j[k : k + PIECE], ids, x)

    def _take(self, i: np.ndarray, j: np.ndarray, ids: pa.Array, x: np.ndarray) -> None:
        score = np.zeros(len(i))
        for d in range(x.shape[1]):  # from left to right
            score += self.q[i, d] * x[j, d]
        self.found.append(pd.DataFrame({"i": i, "score": score, "id": ids.take(pa.array(j)).to_pandas()}))
        self.held += len(i)
        if self.held > 2 * PIECE + 2 * self.k * len(self.q):
            self._rank()

    def _rank(self) -> None:
        best = pd.concat(self.found).sort_values(["i", "score", "id"], ascending=[True, False, True]).groupby("i", sort=False).head(self.k)
        full = best.groupby("i")["score"].agg(["size", "min"])
        full = full[full["size"] >= self.k]
        at = full.index.to_numpy()
        self.floor[at] = np.maximum(self.floor[at], full["min"].to_numpy())
        self.found, self.held = [best], len(best)

    def best(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        if self.found:
            self._rank()
            out = self.found[0]
            table = pa.Table.from_arrays([self.query.take(pa.array(out["i"].to_numpy())), pa.array(out["id"], schema.field("id").type, from_pandas=True), pa.array(out["score"].to_numpy())], schema=schema)
            yield from table.to_batches(max_chunksize=10_000)


def _scored(k: int):
    """Blocks pass by, in each the queries and then the rows by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, block, schema = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            schema = pa.schema([batch.schema.field("query"), batch.schema.field("id"), pa.field("score", pa.float64())])
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("g", "h", "side", "cell")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                g, h, side, cell = keys[:, lo].tolist()
                if (g, h) != unit:
                    if block is not None:
                        yield from block.best(schema)
                    unit, block = (g, h), _Block(k)
                part = batch.slice(lo, hi - lo)
                if side == 0:
                    block.ask(part)
                elif block.parts or block.ready:  # else nobody asks
                    v = part.column("v")
                    block.look(cell, part.column("id"), v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1))
        if block is not None:
            yield from block.best(schema)

    return run


def _in_blocks(pairs: DataFrame, asked: DataFrame, index: Index, cells: list, n_queries: int, k: int) -> DataFrame:
    """query, id, score: the best k rows of each query in each group of the cells it asks for. pairs: query, cell, least."""
    width = max(r["cell"] for r in cells) + 1
    starts, parts, group, filled = [0] * width, [1] * width, 0, 0
    for r in cells:  # small cells share a group, a large one has several
        if filled and filled + r["n"] > ROWS:
            group, filled = group + 1, 0
        starts[r["cell"]], parts[r["cell"]] = group, -(-r["n"] // ROWS)
        group, filled = (group, filled + r["n"]) if r["n"] <= ROWS else (group + parts[r["cell"]], 0)
    many = -(-n_queries // QUERIES)
    at = lambda values: F.get(F.lit(values), F.col("cell"))
    h = F.pmod(F.xxhash64("query"), F.lit(many)).cast("int")
    wanted = pairs.select("query", "cell", "least", F.explode(F.sequence(at(starts), at(starts) + at(parts) - 1)).alias("g"))
    wanted = wanted.groupBy("query", "g").agg(F.first("least").alias("least"), F.collect_list("cell").alias("cells")).join(asked, "query")
    kinds = {c: index.rows.schema[c].dataType for c in ("id", "v")}
    query = asked.schema["query"].dataType
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    ask = wanted.select("g", h.alias("h"), F.lit(0).alias("side"), F.lit(-1).alias("cell"), "query", none(kinds["id"], "id"), F.col("q").alias("v"), "least", "cells")
    own = (at(starts) + F.pmod(F.xxhash64("id"), at(parts))).cast("int").alias("g")
    rows = index.rows.select(own, F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("h"), F.lit(1).alias("side"), "cell", none(query, "query"), "id", "v", none("double", "least"), none("array<int>", "cells"))
    units = (group + 1) * many
    dealt = ask.union(rows).repartition(min(units, 4096), "g", "h").sortWithinPartitions("g", "h", "side", "cell")
    return dealt.mapInArrow(_scored(k), f"query {query.simpleString()}, id {kinds['id'].simpleString()}, score double")


def search(index: Index, queries: DataFrame, id_col: str, vector: str, k: int = 10) -> DataFrame:
    """query, id, score, rank of the k rows with the largest inner product, for each query; ties go to the smallest id."""
    asked, bounded, cells = _bounded(index, queries, id_col, vector)
    n = asked.count()
    if not n or not cells:
        return _best(asked.limit(0).select("query", F.lit(None).cast(index.rows.schema["id"].dataType).alias("id"), F.lit(0.0).alias("score")), k)
    nearest = bounded.filter(F.col("ahead") < k).select("query", "cell", F.lit(float("-inf")).alias("least"))
    first = stored(_best(_in_blocks(nearest, asked, index, cells, n, k), k).drop("rank"))
    rest = _rest(bounded, first, k).select("query", "cell", "least")
    return _best(first.union(_in_blocks(rest, asked, index, cells, n, k)), k)


def retrieve(clusters: DataFrame, candidates: DataFrame, k: int = 50, hours: float = 72, index: Index | None = None) -> DataFrame:
    """The best cluster for each candidate among the k nearest of all: of its entity, of the same type, updated within
    ``hours`` of it.  clusters: cluster, entity, event_type, updated_at, centroid; candidates: id, entity, event_type, ts,
    vector.  Candidates without any are left out."""
    index = index or build(clusters, "cluster", "centroid")
    near = search(index, candidates, "id", "vector", k)
    of = clusters.select(F.col("cluster").alias("id"), F.col("entity").alias("e"), F.col("event_type").alias("t"), F.unix_micros(F.col("updated_at").cast("timestamp")).alias("u"))
    asked = candidates.select(F.col("id").alias("query"), "entity", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    fit = near.join(of, "id").join(asked, "query").filter(F.col("e").eqNullSafe(F.col("entity")) & F.col("t").eqNullSafe(F.col("event_type")) & (F.abs(F.col("us") - F.col("u")) <= int(hours * 3_600_000_000)))
    best = fit.groupBy("query").agg(F.max_by(F.struct("id", "score"), F.struct("score", -F.col("rank"))).alias("b"))
    return best.select(F.col("query").alias("id"), F.col("b.id").alias("cluster"), F.col("b.score").alias("score"))
