"""Quality rules as a bitmask ledger.

``ledger`` evaluates every rule once: it stores the measurements and one failure bit a rule.  A policy is
a named, versioned set of rules, so applying it is one bitwise AND, and the ablation of a rule (how many
rows fail by it alone, how many would come back without it) is an aggregation over the bits: no text is
read a second time.

Defined cases: null texts count as empty (all measurements 0); an empty text fails ``few_words`` only;
equal rows get equal bits and all stay; there are no ties; a very long text is held whole by one task (some 50
bytes a word); an empty table gives an empty ledger; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, small_batches, utf8

SYMBOLS = b"#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
#: name -> SQL over the measurements; the place in this list is the bit. New rules go to the end.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 4 * n_words and n_symbols > 3",
    "repeated_lines": "2 * n_dup_lines > n_lines and n_lines >= 4",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
}
POLICIES = {"base-1": ["few_words", "repeated_words"], "full-1": list(RULES)}


def mask(policy: str) -> int:
    names = list(RULES)
    return sum(1 << names.index(rule) for rule in POLICIES[policy])


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words that stand in a window of ``size`` words found twice or more in the list."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    word = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    window = word[:n]
    for k in range(1, size):
        if k > 1:  # keep the numbers small: a window so far becomes its rank
            window = np.unique(window, return_inverse=True)[1]
        window = window * len(ids) + word[k : n + k]
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(size):
        covered[k : n + k] |= twice
    return int(covered.sum())


def measure(text: bytes) -> tuple[int, ...]:
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.split()] if b"\n" in text else [text] if words else []
    chars = len(text.decode("utf-8", "replace")) - (len(text) - len(text.translate(None, SPACE)))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return len(words), chars, symbols, len(lines), len(lines) - len(set(lines)), repeated_words(words)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measure(x) for x in utf8(batch.column(1))]
        cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(MEASURES))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["id", *MEASURES])


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a record: id, the measurements and ``fail_bits``."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_measured, f"id {kind}, " + ", ".join(f"{m} bigint" for m in MEASURES))
    bits = sum((F.expr(f"case when {rule} then {1 << k}L else 0L end") for k, rule in enumerate(RULES.values())), F.lit(0).cast("bigint"))
    return rows.withColumn("fail_bits", bits).withColumnRenamed("id", id_col)


def apply_policy(rows: DataFrame, policy: str) -> DataFrame:
    return rows.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("bigint")) == 0)


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: rows that fail it, rows that fail nothing else, and rows kept without it."""
    m = mask(policy)
    names = list(RULES)
    bits = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m).cast("bigint")).alias("b")).count()  # at most 2**rules rows
    rules = [F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("bigint").alias("bit")) for r in POLICIES[policy]]
    each = bits.select("b", "count", F.explode(F.array(*rules)).alias("r"))
    hit = F.col("b").bitwiseAND(F.col("r.bit")) != 0
    without = F.col("b").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("count")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("b") == F.col("r.bit"), F.col("count")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(without, F.col("count")).otherwise(0)).alias("n_kept_without"),
    )
