"""Golden values of literal fixtures, and every registered query against its SQL."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidemark.functions import scoring as S
from tidemark.functions import text
from tidemark.functions.text import timestamp
from tidemark.operators import checks, clustering, evaluate, ingest, market, portfolio, rules
from tidemark.plans import registry
from tidemark.sources import observations, synthetic
from tidemark.streaming import ingest as stream

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    return float(f"{v:.9g}") if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/sf0.001/{t}.parquet'")
    df, sql = registry.queries()[name](spark, f"{DATA}/sf0.001"), con.sql(registry.oracles()[name])
    cols = sorted(df.columns)
    assert sorted(sql.columns) == cols
    got = sorted(repr([norm(r[c]) for c in cols]) for r in df.collect())
    assert got == sorted(repr([norm(r[sql.columns.index(c)]) for c in cols]) for r in sql.fetchall())


def test_stress_goldens(spark):
    signals = [("T", "Credit Event", "Tesla", 10.0), ("G", "Geopolitical", "Germany", 8.0), ("P", "Commodity / Supply Chain", "PetroGlobal", 9.2), ("M", "Market / Liquidity", "Global", 10.0), ("N", "NO_EVENT", "Apple", 5.0), ("U", "Credit Event", "Unknown", 10.0), ("X", "Credit Event", "Tesla", 99.0)]
    shocks = portfolio.shock_map(spark.createDataFrame(signals, "event_id string, event_type string, entity string, impact double"))
    got = {r["event_id"]: (r["n_affected"], float(r["affected_ead"]), float(r["incremental_el"]), float(r["mtm_impact"])) for r in portfolio.totals(shocks, portfolio.stress(shocks, synthetic.portfolio(spark))).collect()}
    assert got["T"] == (2, 35e6, 2_295_000.0, -9e6)
    assert got["G"] == (2, 75e6, pytest.approx(2113293.399075), pytest.approx(-3111120.0))
    assert got["P"] == (7, 420e6, pytest.approx(8587353.65712), pytest.approx(-6696690.0))
    assert got["M"] == (22, 860e6, 12_374_400.0, -30.7e6)
    assert got["N"] == got["U"] == got["X"] == (0, 0, 0, 0)


def test_impact_goldens(spark):
    rows = [("Product / Technology", 0.65, 0.8, 0.8, 3.90), ("Corporate / Earnings", 0.90, 1.0, -0.7, 6.98), ("Credit Event", 0.95, 1.0, -0.9, 10.0), ("Merger & Acquisition", 0.88, 1.0, 0.2, 6.90), ("Macroeconomic", 0.92, 1.0, -0.1, 7.38)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "t string, c double, cred double, s double, want double, nov double")
    raw = S.raw_impact(F.col("t"), F.col("c"), F.col("cred"), F.col("nov"), F.col("s"), F.lit(1.0))
    for r in df.select("want", S.impact(F.lit("MATERIAL_EVENT"), raw).alias("got")).collect():
        assert r["got"] == pytest.approx(r["want"], abs=0.006)


def test_guard_fixture(spark):
    rows = [("Company filed for bankruptcy", "Acme", "valid", "Credit Event", True), ("How to change the default browser on Mac", "Mac", "valid", "Credit Event", False), ("Acme announces new product", "Acme", "valid", "Product / Technology", True)]
    got = rules.credit_guard(spark.createDataFrame(rows, "t string, e string, s string, k string, want boolean"), "t", "e", "s", "k").collect()
    assert [r["credit_guard_pass"] for r in got][1:] == [False, True]


def test_market_fixture(spark):
    days = ["02", "03", "04", "05", "08", "09", "10", "11", "12", "15"]
    bars = spark.createDataFrame([("A", f"2024-01-{d}", 110.0 if d == "15" else 100.0, 2_000_000 if d == "15" else 1_000_000) for d in days], "ticker string, trade_date string, close double, volume long").withColumn("trade_date", F.to_date("trade_date"))
    index = spark.createDataFrame([(f"2024-01-{d}", 3900.0 if d == "15" else 3800.0) for d in days], "trade_date string, index_close double").withColumn("trade_date", F.to_date("trade_date"))
    r = market.windows(bars, index, baseline=9, least=8, returns=9).orderBy(F.desc("trade_date")).first()
    assert r["window_return"] == pytest.approx(0.10) and r["abnormal_return"] == pytest.approx(0.073684, abs=1e-6)
    assert r["volume_ratio"] == 2.0 and r["volatility"] == 0.0
    e = spark.createDataFrame([(1, "A", "2024-01-13"), (2, "B", "2024-01-13")], "event_id long, ticker string, event_date string").withColumn("event_date", F.to_date("event_date"))
    got = {r["event_id"]: str(r["anchor_date"]) for r in market.as_of(e, bars).collect()}
    assert got == {1: "2024-01-12", 2: "None"}


def test_ordered_clusters(spark):
    t = lambda h: f"2024-01-01 {h:02d}:00:00"
    rows = [("F", 0, t(0), "Geopolitical", [1.0, 0.0]), ("F", 1, t(1), "Macroeconomic", [0.99, 0.05]), ("F", 2, t(2), "Product / Technology", [1.0, 0.0]), ("F", 3, t(3), "Geopolitical", [0.0, 1.0]), ("G", 4, t(3), "Geopolitical", [1.0, 0.0]), ("F", 5, t(4), "Geopolitical", [1.0, 0.01])]
    df = spark.createDataFrame(rows, "entity string, seq long, ts string, event_type string, vector array<double>").withColumn("ts", F.to_timestamp("ts"))
    got = {r["seq"]: (r["cluster_id"], round(r["novelty"], 6)) for r in clustering.assign(df).collect()}
    assert got == {0: (0, 1.0), 1: (0, 0.5), 2: (2, 1.0), 3: (3, 1.0), 4: (4, 1.0), 5: (0, 0.333333)}


def test_timestamps_and_signals(spark):
    df = spark.createDataFrame([("2024-03-01T10:00:00Z",), ("31/01/2017",), ("20231015093000Z",), ("no",)], "t string").select(timestamp(F.col("t")).cast("string").alias("x"))
    assert [r["x"] for r in df.collect()] == ["2024-03-01 10:00:00", "2017-01-31 00:00:00", "2023-10-15 09:30:00", None]
    d = spark.createDataFrame([("www.reuters.com", "TAX_FNCACT_CEO; X"), ("notreuters.com", "OTHER")], "d string, th string")
    assert [(r["a"], r["b"]) for r in d.select(ingest.domain_signal(F.col("d")).alias("a"), ingest.theme_signal(F.col("th")).alias("b")).collect()] == [(True, True), (False, False)]


def test_records_are_rebuilt(spark):
    tail = ",".join(["1"] * 10)
    lines = [("f", 0, "first text"), ("f", 1, "goes on"), ("f", 2, f",Ford,31/01/2017,{tail}"), ("f", 3, "second"), ("f", 4, f'",Acme,01/02/2017,{tail}')]
    got = observations.join_lines(spark.createDataFrame(lines, "file string, n int, line string"), "file", "n", "line").orderBy("record").collect()
    assert [r["text"] for r in got] == ["first text\ngoes on", "second"]


def test_stream_dedupes_like_the_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for k in range(2):
        (src / f"{k}.json").write_text("\n".join(f'{{"url": "u{j}", "title": "t", "domain": "d", "seendate": "20240101{j:02d}0000Z", "language": "en"}}' for j in (0, 1, k + 2)))
    q = stream.first_seen(stream.articles(spark, str(src))).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["url"] for r in spark.sql("select url from seen").collect()) == ["u0", "u1", "u2", "u3"]


def test_a_dropped_row_registers_no_keys(spark):
    rows = [(1, "u1", "h1"), (2, "u2", "h1"), (3, "u2", "h3"), (4, None, "h4"), (5, None, "h5"), (6, "u6", "h3")]
    got = ingest.first_seen(spark.createDataFrame(rows, "seq long, u string, h string"), [F.col("u"), F.col("h")], "seq")
    assert sorted(r["seq"] for r in got.collect()) == [1, 3, 4]
    rng = random.Random(1)
    rows = [(k, f"u{rng.randrange(40)}", f"h{rng.randrange(40)}", f"p{rng.randrange(60)}") for k in range(200)]
    seen, kept = set(), []
    for k, *keys in rows:
        named = set(enumerate(keys))
        if not named & seen:
            seen |= named
            kept.append(k)
    got = ingest.first_seen(spark.createDataFrame(rows, "seq long, u string, h string, p string"), [F.col("u"), F.col("h"), F.col("p")], "seq")
    assert sorted(r["seq"] for r in got.collect()) == kept
    assert ingest.first_seen(got.limit(0), [F.col("u")], "seq").count() == 0


def test_types_and_places_in_any_case(spark):
    shocks = portfolio.shock_map(spark.createDataFrame([("A", " credit EVENT ", "Tesla", 10.0), ("B", "Geopolitical", "GERMANY", 8.0)], "event_id string, event_type string, entity string, impact double"))
    want = portfolio.shock_map(spark.createDataFrame([("A", "Credit Event", "Tesla", 10.0), ("B", "Geopolitical", "Germany", 8.0)], "event_id string, event_type string, entity string, impact double"))
    assert shocks.drop("event_type", "entity").collect() == want.drop("event_type", "entity").collect()
    book = synthetic.portfolio(spark).withColumn("geography", F.when(F.col("exposure_id") % 2 == 0, F.lower("geography")).otherwise(F.col("geography")))
    n = {r["event_id"]: r["n_affected"] for r in portfolio.totals(shocks, portfolio.stress(shocks, book)).collect()}
    assert n == {"A": 2, "B": 2}


def test_portfolio_rows(spark):
    rows = synthetic.portfolio(spark).collect()
    assert len(rows) == 22 and rows[0]["exposure_name"] == "EXP-0001" and {r["rating"] for r in rows} == {"AAA", "AA", "A", "BBB", "BB", "B", "CCC", "NR"}
    assert sum(r["ead"] for r in rows) == 860_000_000 and all((r["duration"] is not None) == (r["asset_type"] == "Corporate Bond") for r in rows)


def test_money(spark):
    rows = [(2_295_000.0, "$2.295M"), (-9e6, "-$9.000M"), (12.5, "$12.50"), (1_500.0, "$1.500K"), (8.6e9, "$8.600B"), (0.0, "$0.00")]
    got = spark.createDataFrame(rows, "x double, want string").select("want", text.money(F.col("x")).alias("got")).collect()
    assert all(r["got"] == r["want"] for r in got)


def test_leakage_is_an_error(spark):
    df = spark.createDataFrame([(1, 2.0)], "id long, Return_1d double")
    assert checks.leaking(df, ["return_1d"]) == ["Return_1d"]
    with pytest.raises(ValueError):
        checks.assert_no_leakage(df, ["return_1d"])
    assert checks.assert_no_leakage(df, ["other"]) is df


def test_names_resolve_in_order(spark):
    aliases = spark.createDataFrame([("Acme", "E1", "Acme Corporation"), ("acme", "E2", "Other"), ("ft", "E3", "FT"), ("Bolt", "E4", "")], "alias string, entity_id string, canonical string")
    said = [" ACME ", "Acme, Inc.", "Acme Corp", "FT", "Bolt", "Nobody Ltd", "", None, "Inc."]
    names = spark.createDataFrame([(k, n, "x") for k, n in enumerate(said)], "k int, name string, alias string")
    got = {r.k: (r.entity_id, r.canonical, r.status, r.confidence) for r in ingest.resolve(names, "name", aliases).collect()}
    none = (None, "", "unresolved_entity", 0.0)
    assert [got[k] for k in range(len(said))] == [
        ("E1", "Acme Corporation", "valid", 1.0), ("E1", "Acme Corporation", "valid", 0.85), ("E1", "Acme Corporation", "valid", 0.85), (None, "", "unresolved_source", 0.0), ("E4", "Bolt", "valid", 1.0),
        (None, "Nobody Ltd", "unresolved_entity", 0.0), none, none, (None, "Inc.", "unresolved_entity", 0.0),
    ]


def test_score_decides_only_about_rows_without_reason(spark):
    rows = spark.createDataFrame([(1, True, 0.9), (2, False, 0.3), (3, False, 0.2), (4, None, None), (5, True, None)], "id int, hit boolean, p double")
    got = {r.id: (r.reasons, r.kept) for r in ingest.candidate_filter(rows, {"KEYWORD": F.col("hit")}, F.col("p")).collect()}
    assert got == {1: (["KEYWORD"], True), 2: (["SEMANTIC"], True), 3: ([], False), 4: ([], False), 5: (["KEYWORD"], True)}
