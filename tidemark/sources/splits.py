"""Records of delimited files whose fields hold line feeds, rebuilt split by split.

A file is read by many tasks, none of which knows whether its split begins inside a quoted field and how many fields of
an unfinished record came before.  The first pass runs each split from both quote states and for every number of pending
fields, and keeps where each leads: a small map a split.  Chained over the splits of a file these maps give each split's
true start and the number of its first record.  The second pass parses for good; records inside a split come out at
once, and only the pieces at the ends of splits are put together by a shuffle.

A logical record takes 14 fields where at least 14 are pending when a physical row ends, and 13 where there are exactly
13.  Fields that are left over at a file's end are an error, as is a quote that never closes.
"""

from __future__ import annotations

import csv
import json
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .observations import COLUMNS
from .scratch import stored

LONG, SHORT = 14, 13
#: Pending fields that a split's end may have; more is an error.
PENDING = 64
_END = "\x01end of split\x01"
#: The fixed name of the optional last field.
MENTION = "MENTION"


def _rows(lines: Iterable[str], inside: bool) -> Iterator[tuple[list[str], bool]]:
    """Physical rows of a split, and for the last whether it goes on in the next split."""
    csv.field_size_limit(sys.maxsize)

    def fed() -> Iterator[str]:
        first = '"' if inside else ""
        for line in lines:
            yield f"{first}{line}\n"
            first = ""
        yield first + _END  # is a row of its own, or the end of an open field

    for row in csv.reader(fed()):
        if row and row[-1].endswith(_END):
            row[-1] = row[-1].removesuffix(_END)
            if len(row) > 1 or row[0]:
                row[-1] = row[-1].removesuffix("\n")
                yield row, True
            elif inside and not row[0]:
                yield row, True
        elif row:
            yield row, False
        inside = inside and not row


def _lead(lines: list[str], inside: bool) -> tuple[bool, np.ndarray, np.ndarray]:
    """Where the split leads from each number of pending fields: whether it ends inside quotes, the numbers then, and the records finished."""
    n, done, ends_inside = np.arange(PENDING), np.zeros(PENDING, np.int64), False
    for row, goes_on in _rows(lines, inside):
        if goes_on:
            n, ends_inside = n + len(row) - 1, True
        else:
            t = n + len(row)
            n = np.where(t < SHORT, t, np.where(t >= LONG, t - LONG, 0))
            done += t >= SHORT
    return ends_inside, n, done


def _splits(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, list[str]]]:
    """The lines of each split; they come in order, split after split."""
    key, lines, state = None, [], None
    for frame in frames:
        extra = frame["state"] if "state" in frame else [None] * len(frame)
        for file, start, line, s in zip(frame["file"], frame["start"], frame["value"], extra, strict=True):
            if (file, start) != key:
                if key is not None:
                    yield (*key, state), lines
                key, lines, state = (file, start), [], s
            lines.append(line)
    if key is not None:
        yield (*key, state), lines


def _summaries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for (file, start, _), lines in _splits(frames):
        leads = [_lead(lines, inside) for inside in (False, True)]
        yield pd.DataFrame({"file": [file], "start": [start], "leads": [json.dumps([(bool(q), n.tolist(), d.tolist()) for q, n, d in leads])]})


def _chained(frame: pd.DataFrame) -> pd.DataFrame:
    """The state in which each split of one file begins: inside quotes, pending fields, records before."""
    inside, n, record, out = False, 0, 0, []
    frame = frame.sort_values("start")
    for leads in frame["leads"]:
        out.append(json.dumps((inside, n, record)))
        q, ns, done = json.loads(leads)[int(inside)]
        record, n, inside = record + done[n], ns[n], q
        if n >= PENDING:
            raise ValueError(f"{frame['file'].iloc[0]}: more than {PENDING} fields without a record")
    if n or inside:
        raise ValueError(f"unparsed trailing fields in {frame['file'].iloc[0]}: {n + inside} values")
    return pd.DataFrame({"file": frame["file"], "start": frame["start"], "state": out})


def _pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """file, record, start, fields, part: whole records, and parts of those that began before the split or go on behind it.
    The first field of a part may continue the last of the part before."""
    for (file, start, state), lines in _splits(frames):
        inside, before, record = json.loads(state)
        out, held, joins = [], [], inside

        def put(fields: list[str], part: bool) -> None:
            out.append((file, record, start, fields, part, joins and part))  # noqa: B023

        for row, goes_on in _rows(lines, inside):
            held += row
            total = before + len(held)
            if not goes_on and total >= SHORT:
                take = LONG if total >= LONG else SHORT
                own = max(0, take - before)
                if own:
                    put(held[:own], before > 0 or joins)
                    joins = False
                held, before, record = held[own:], max(0, before - take), record + 1
        while held:  # what is pending: fields of the next record, of 14 each if there are more
            own = max(0, LONG - before)
            if own:
                put(held[:own], True)
                joins = False
            held, before, record = held[own:], max(0, before - LONG), record + 1
        yield pd.DataFrame(out, columns=["file", "record", "start", "fields", "part", "joins"])


def records(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """file, record (its number in the file, from 0), fields."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    if split_bytes:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    try:
        lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
        found = lines.mapInPandas(_summaries, "file string, start long, leads string").groupBy("file").applyInPandas(_chained, "file string, start long, state string").collect()  # a row a split
        states = spark.createDataFrame(found or [], "file string, start long, state string")
        pieces = lines.join(F.broadcast(states), ["file", "start"]).mapInPandas(_pieces, "file string, record long, start long, fields array<string>, part boolean, joins boolean")
        pieces = stored(pieces)  # now, while files are cut as in the first pass
        whole = pieces.filter("not part").select("file", "record", "fields")
        glue = lambda s, p: F.when(p["joins"] & (F.size(s) > 0), F.concat(F.slice(s, 1, F.size(s) - 1), F.array(F.concat(F.element_at(s, -1), F.lit("\n"), p["fields"][0])), F.slice(p["fields"], 2, F.size(p["fields"])))).otherwise(F.concat(s, p["fields"]))
        parts = pieces.filter("part").groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("start", "fields", "joins"))).alias("p"))
        out = whole.union(parts.select("file", "record", F.aggregate("p", F.array().cast("array<string>"), glue).alias("fields")))
        return out
    finally:
        if split_bytes:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def typed(rebuilt: DataFrame, rows: int | None = None) -> DataFrame:
    """The named columns with their types; day-first dates and numbers that don't parse are null.  ``rows`` keeps the first
    records of each file."""
    if rows is not None:
        rebuilt = rebuilt.filter(F.col("record") < rows)
    named = [F.get("fields", F.lit(k)).alias(c) for k, c in enumerate([*COLUMNS, MENTION])]
    raw = rebuilt.select("file", "record", *named)
    number = [c for c in COLUMNS if c not in ("TWEET", "STOCK", "DATE")]
    return raw.select("file", "record", "TWEET", "STOCK", F.expr("cast(try_to_timestamp(trim(DATE), 'dd/MM/yyyy') as date)").alias("DATE"), *[F.expr(f"try_cast(trim(`{c}`) as double)").alias(c) for c in number], MENTION)
