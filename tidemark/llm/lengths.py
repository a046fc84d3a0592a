"""Token counts from an exact length histogram.

Documents are aggregated by encoded length; everything else is answered from that histogram.  With running
sums over the lengths, each length L is a context limit for which the table holds the documents that fit,
the documents that are longer, and the tokens that are left when every document is cut at L.

Defined cases: null and empty texts have length 0; repeated rows count one by one; equal lengths are one row, so
there are no ties; a very long text is held whole by one task; an empty table gives an empty histogram; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import codec
from .common import small_batches, utf8, written

BLOCK = 256


def _lengths(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = [x.decode() for x in utf8(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([len(x) // c.dtype.itemsize for x in c.encode(texts)], pa.int64())], ["n_tokens"])

    return run


def histogram(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """n_tokens, n_docs: exact, over all rows. It is written, so that no reader encodes the corpus again."""
    small_batches(docs.sparkSession)
    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(_lengths(path), "n_tokens bigint").groupBy("n_tokens").agg(F.count("*").alias("n_docs"))
    return written(counted, "lengths")


#: Shares of the documents whose length is answered.
QUANTILES = {"p50": 0.5, "p90": 0.9, "p99": 0.99}


def limits(hist: DataFrame, quantiles: dict[str, float] = QUANTILES) -> DataFrame:
    """For every length as a context limit: n_docs, n_fit, n_longer, n_at_least, total_tokens, truncated_tokens,
    share (of documents that fit) and, for each quantile, the length that this share of the cut documents has at most.

    The sums run in two levels, over blocks of lengths and inside a block, so no task orders all lengths."""
    h = hist.withColumn("b", F.floor(F.col("n_tokens") / BLOCK)).withColumn("t", F.col("n_tokens") * F.col("n_docs"))
    block = h.groupBy("b").agg(F.sum("n_docs").alias("bd"), F.sum("t").alias("bt"))
    ahead, all_ = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    block = block.select("b", F.coalesce(F.sum("bd").over(ahead), F.lit(0)).alias("d0"), F.coalesce(F.sum("bt").over(ahead), F.lit(0)).alias("t0"), F.sum("bd").over(all_).alias("docs"), F.sum("bt").over(all_).alias("total_tokens"))
    upto = Window.partitionBy("b").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    h = h.join(block, "b").withColumn("n_fit", F.col("d0") + F.sum("n_docs").over(upto)).withColumn("fit_tokens", F.col("t0") + F.sum("t").over(upto))
    longer = F.col("docs") - F.col("n_fit")
    out = h.select("n_tokens", "n_docs", "n_fit", longer.alias("n_longer"), (longer + F.col("n_docs")).alias("n_at_least"), "total_tokens", (F.col("fit_tokens") + F.col("n_tokens") * longer).alias("truncated_tokens"), (F.col("n_fit") / F.col("docs")).alias("share"))
    at = out.agg(*[F.min(F.when(F.col("share") >= q, F.col("n_tokens"))).alias(name) for name, q in quantiles.items()])  # one row
    return out.crossJoin(F.broadcast(at)).select(*out.columns, *[F.least("n_tokens", name).alias(name) for name in quantiles])


def answer(limit_table: DataFrame, limit: int) -> DataFrame:
    """Total, documents cut and tokens left for one context limit, whether or not a document has that length."""
    below, above = F.col("n_tokens") <= limit, F.col("n_tokens") > limit
    x = limit_table.agg(
        F.max_by(F.struct("n_fit", "n_longer", "truncated_tokens", "n_tokens"), F.when(below, F.col("n_tokens"))).alias("x"),
        F.max(F.when(above, F.col("n_at_least"))).alias("more"),
    )
    cut = F.coalesce("more", F.lit(0))
    left = F.coalesce(F.col("x.truncated_tokens") - F.col("x.n_longer") * F.col("x.n_tokens"), F.lit(0)) + cut * limit
    return x.select(F.lit(limit).alias("limit"), F.coalesce("x.n_fit", F.lit(0)).alias("n_fit"), cut.alias("n_cut"), left.alias("tokens_left"))
