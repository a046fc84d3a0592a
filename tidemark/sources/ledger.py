"""Chunks of a long run, with a ledger that a rerun goes on from.

Each chunk of the input is written into a folder of its own attempt, and counts once its record, one small file, names
that folder as COMPLETE; the record is replaced by an atomic rename.  A run that is stopped at any place leaves records
that tell what is done: the next one skips those chunks, writes the others anew, and readers never see what a stopped
attempt left.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import store

COMPLETE, IN_PROGRESS, FAILED = "COMPLETE", "IN_PROGRESS", "FAILED"
SCHEMA = "chunk_id string, input_start long, input_end long, status string, input_rows long, output_rows long, seconds double, written_at string, path string, versions string, error string"


def ranges(rows: DataFrame, key: str, size: int) -> list[tuple[int, int]]:
    """Ranges [start, end) of a whole-number key with about ``size`` rows each where keys are dense; one a chunk."""
    low, high, n = rows.agg(F.min(key), F.max(key), F.count(key)).first()
    if not n:
        return []
    width = -(-(high - low + 1) // max(1, -(-n // size)))
    return [(start, start + width) for start in range(low, high + 1, width)]


class Ledger:
    """``versions`` names what a chunk's result depends on (code, settings, models): with others it is made anew."""

    def __init__(self, spark: SparkSession, folder: str, versions: dict[str, str] | None = None):
        self.spark, self.folder = spark, folder
        self.versions = json.dumps(versions or {}, sort_keys=True)

    def _record(self, chunk: str) -> str:
        return f"{self.folder}/ledger/{chunk}.json"

    def _put(self, record: dict) -> None:
        store.swap(self.spark, self._record(record["chunk_id"]), json.dumps(record))

    def records(self) -> list[dict]:
        """All records, by input range; one that can't be read counts as none."""
        out = []
        for name in store.names(self.spark, f"{self.folder}/ledger"):
            if name.endswith(".json"):
                try:
                    out.append(json.loads(store.text_of(self.spark, f"{self.folder}/ledger/{name}") or ""))
                except json.JSONDecodeError:
                    continue
        return sorted(out, key=lambda r: (r["input_start"], r["input_end"]))

    def table(self) -> DataFrame:
        cols = [c.split()[0] for c in SCHEMA.split(", ")]
        return self.spark.createDataFrame([tuple(r.get(c) for c in cols) for r in self.records()], SCHEMA)

    def done(self) -> list[dict]:
        return [r for r in self.records() if r["status"] == COMPLETE and r["versions"] == self.versions]

    def run(self, source: DataFrame, key: str, chunks: Iterable[tuple[int, int]], step: Callable[[DataFrame], DataFrame], before_commit: Callable[[str], None] | None = None) -> list[str]:
        """Apply ``step`` to each chunk [start, end) of ``key`` that is not done; the ids of those that were written.

        Rows are counted by the job that writes them.  A step that fails leaves a FAILED record and stops the run."""
        done, written = {r["chunk_id"] for r in self.done()}, []
        for start, end in chunks:
            chunk = f"{start:020d}-{end:020d}"
            if chunk in done:
                continue
            attempt = f"data/{chunk}/{uuid.uuid4().hex}"
            record = {"chunk_id": chunk, "input_start": start, "input_end": end, "status": IN_PROGRESS, "path": attempt, "versions": self.versions}
            self._put(record)
            began = time.time()
            try:
                read = Observation(uuid.uuid4().hex)
                rows = source.filter((F.col(key) >= start) & (F.col(key) < end)).observe(read, F.count(F.lit(1)).alias("rows"))
                n = store.written(step(rows), f"{self.folder}/{attempt}")
                if before_commit:
                    before_commit(chunk)
            except Exception as error:
                self._put(record | {"status": FAILED, "error": str(error)[:2000], "seconds": time.time() - began, "written_at": datetime.now(UTC).isoformat()})
                raise
            self._put(record | {"status": COMPLETE, "input_rows": int(read.get["rows"]), "output_rows": n["rows"], "seconds": time.time() - began, "written_at": datetime.now(UTC).isoformat()})
            written.append(chunk)
            for old in store.names(self.spark, f"{self.folder}/data/{chunk}"):
                if not attempt.endswith(old):
                    store.remove(self.spark, f"{self.folder}/data/{chunk}/{old}")
        return written

    def read(self, schema: str) -> DataFrame:
        """The rows of all chunks that are done."""
        paths = [f"{self.folder}/{r['path']}" for r in self.done()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)


def throughput(records: DataFrame) -> DataFrame:
    """One row about the chunks that are complete: chunks, rows in and out, seconds, and rows a second."""
    done = records.filter(F.col("status") == COMPLETE)
    return done.agg(F.count("*").alias("chunks"), F.coalesce(F.sum("input_rows"), F.lit(0)).alias("input_rows"), F.coalesce(F.sum("output_rows"), F.lit(0)).alias("output_rows"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"), F.try_divide(F.sum("input_rows").cast("double"), F.sum("seconds")).alias("rows_per_s"))
