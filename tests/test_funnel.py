"""The funnel's signals on odd texts."""

import duckdb
from pyspark.sql import functions as F

from tidemark.operators import ingest
from tidemark.plans import registry


def test_substrings_and_names(spark):
    rows = [(0, "a sec"), (1, "second.stake"), (2, ""), (3, None), (4, "x.y"), (5, "gnu license"), (6, "gnu  license"), (7, "agnu license"), (8, "the gnu license v2")]
    got = spark.createDataFrame(rows, "k long, t string").select("k", ingest.any_substring(F.col("t"), ["sec", ".s"]).alias("a"), ingest.names_any(F.col("t"), ["gnu license"]).alias("b"), ingest.any_substring(F.col("t"), []).alias("c")).collect()
    assert {r.k: r.a for r in got} == {0: True, 1: True, 2: False, 3: None, 4: False, 5: False, 6: False, 7: False, 8: False}
    assert [r.k for r in got if r.b] == [5, 8] and not any(r.c for r in got)


def test_funnel_reads_texts_once_and_shuffles_none(spark, tmp_path):
    """no row for each word, no join back; an id that two texts share is not mixed up, and long texts stay whole."""
    long = "word " * 20_000
    rows = [(1, long + "ALL RIGHTS RESERVED", "src9"), (1, "nothing", "src9"), (2, "you idiot", "src0"), (3, None, None), (99, long, "src9"), (4, "you idiots", "src9")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    df = registry.queries()["funnel_with_fallback"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    sql = con.sql(registry.oracles()["funnel_with_fallback"])
    order = lambda r: str(r)
    assert sorted((tuple(r[c] for c in sql.columns) for r in df.collect()), key=order) == sorted(sql.fetchall(), key=order)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
