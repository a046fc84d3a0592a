"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
SPACE = b" \t\n\x0b\x0c\r"
#: Words are the runs of anything but the six ASCII white-space characters.
WORD = "[^\\x20\\x09-\\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession, rows: int = 500, size: int = 16 << 20) -> None:
    """Bound the Arrow batches by rows and bytes, so that a Python worker holds few texts at once.

    Spark reads these settings when a job starts, so they stay set; larger ones of the session are lowered."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key)
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


@lru_cache(1)
def _own_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='spark-')}"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of this machine only where driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named or _own_dir()


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that no later step reads."""
    for table in tables:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_key(text: Column) -> Column:
    """128 bits that tell texts apart (null counts as empty)."""
    text = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text, F.lit(7)).alias("b"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def unsigned(h: Column) -> Column:
    """A signed 64-bit hash as a double in [0, 1)."""
    return (F.shiftrightunsigned(h, 11).cast("double")) / F.lit(float(1 << 53))


#: At most 2**MOST bits (256 MB) in a bit set.
MOST = 31


def bitmap(df: DataFrame, key: str):
    """Broadcast a bit set with the bits of all values of a 64-bit hash column: some 32 to 64 bits a value,
    so that few others seem to be in it.

    It grows with the number of values up to 256 MB (67 million values).  It only says "surely not there" or
    "perhaps there": callers leave out work early and an exact step follows, so with still more values more
    rows reach that step and results stay the same."""
    values = written(df.select(F.col(key).alias("p")), "values")
    bits = min(max((32 * values.count()).bit_length(), 10), MOST)
    place = F.shiftrightunsigned(F.col("p"), 64 - bits)
    words = values.select(place.alias("p")).selectExpr("cast(p >> 6 as int) as i", "shiftleft(1L, cast(p & 63 as int)) as b")
    words = words.groupBy("i").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words.column("i").to_numpy()] = words.column("b").to_numpy()
    discard(values)
    return df.sparkSession.sparkContext.broadcast(out)


def in_bitmap(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bits = int(len(words)).bit_length() - 1 + 6
    place = keys.view(np.uint64) >> np.uint64(64 - bits)
    return (words[(place >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (place & np.uint64(63))) & np.uint64(1) == 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finalizer of a well-known generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Entries of a worker's cache of words; some 200 bytes each.
CACHED = 150_000
_live: list[dict] = []


def alone(cache: dict) -> dict:
    """The one cache that a worker process holds: others are emptied, since workers serve one operator after the other."""
    if not _live or _live[0] is not cache:
        for other in _live:
            other.clear()
        _live[:] = [cache]
    return cache


class WordHashes(dict):
    """64-bit hashes of words, kept while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(alone(self).__getitem__, words), np.uint64, len(words))


#: Shared by all operators that hash words.
HASHES = WordHashes()
