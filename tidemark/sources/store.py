"""Tables that change together: immutable versions named by one manifest, checked in the job that writes them.

A commit writes each table into a folder of its own and then replaces the manifest by one atomic rename, so readers see
all tables of a commit or none, and a writer that dies leaves only folders that no manifest names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    p = _path(spark, path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def swap(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file by an atomic rename: readers get the old text or the new one, whole."""
    jvm = spark.sparkContext._jvm
    files, target = _files(spark, path)
    own = _path(spark, f"{path}.{uuid.uuid4().hex}")
    out = files.create(own, True)
    out.write(bytearray(text.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    option = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    option[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(own, target, option)


def text_of(spark: SparkSession, path: str) -> str | None:
    files, p = _files(spark, path)
    if not files.exists(p):
        return None
    stream = files.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    files, p = _files(spark, path)
    files.delete(p, True)


def names(spark: SparkSession, folder: str) -> list[str]:
    files, p = _files(spark, folder)
    return sorted(s.getPath().getName() for s in files.listStatus(p)) if files.exists(p) else []


class Rejected(ValueError):
    """A table that broke its checks; ``found`` has the counts."""

    def __init__(self, table: str, found: dict[str, int]):
        super().__init__(f"{table}: {', '.join(f'{k} {v}' for k, v in found.items())}")
        self.found = found


def written(df: DataFrame, path: str, checks: Mapping[str, Column] | None = None) -> dict[str, int]:
    """Write a table and count its rows and those that break each check (a condition that holds for bad rows, null for
    good ones), in the one job that writes it."""
    seen = Observation(uuid.uuid4().hex)
    bad = [F.count(F.when(c, 1)).alias(name) for name, c in (checks or {}).items()]
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *bad).write.parquet(path)
    return {k: int(v) for k, v in seen.get.items()}


class Store:
    """Named tables below one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.manifest = f"{folder}/manifest.json"

    def current(self) -> dict:
        return json.loads(text_of(self.spark, self.manifest) or '{"version": 0, "tables": {}}')

    def read(self, table: str, schema: str | None = None) -> DataFrame:
        """The table of the last commit; an empty one of the schema before its first."""
        entry = self.current()["tables"].get(table)
        if entry is None:
            if schema is None:
                raise ValueError(f"no such table: {table}")
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.folder}/{entry['path']}")

    def commit(self, tables: Mapping[str, DataFrame], checks: Mapping[str, Mapping[str, Column]] | None = None) -> dict:
        """Write the tables and make them current together; a table that breaks a check stops the commit, and so does a
        commit by another writer in between."""
        before, new, found = self.current(), {}, {}
        for name, df in tables.items():
            path = f"{name}/{uuid.uuid4().hex}"
            found[name] = written(df, f"{self.folder}/{path}", (checks or {}).get(name))
            new[name] = {"path": path, "rows": found[name]["rows"]}
        broken = {name: {k: v for k, v in f.items() if k != "rows" and v} for name, f in found.items()}
        stopped = next((name for name, f in broken.items() if f), None)
        if stopped or self.current()["version"] != before["version"]:
            for entry in new.values():
                remove(self.spark, f"{self.folder}/{entry['path']}")
            if stopped:
                raise Rejected(stopped, broken[stopped])
            raise RuntimeError("another commit came first")
        after = {"version": before["version"] + 1, "tables": {**before["tables"], **new}}
        swap(self.spark, self.manifest, json.dumps(after))
        return after

    def vacuum(self) -> int:
        """Delete folders that the manifest does not name, those of readers of old versions too; how many there were."""
        kept, gone = {e["path"] for e in self.current()["tables"].values()}, 0
        for table in names(self.spark, self.folder):
            if table != "manifest.json":
                for version in names(self.spark, f"{self.folder}/{table}"):
                    if f"{table}/{version}" not in kept:
                        remove(self.spark, f"{self.folder}/{table}/{version}")
                        gone += 1
        return gone
