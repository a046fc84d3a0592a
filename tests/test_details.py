"""Replay of dumps over restarts, names, selections, observations and records on literal cases."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import clustering, evaluate, records, rules
from tidemark.sources import sinks, store
from tidemark.streaming import ingest


def article(k, **more):
    return {"url": f"http://u/{k}", "title": f"title {k}", "seendate": f"202401{k % 28 + 1:02d}120000Z", "domain": "d.com", "language": "English", "sourcecountry": "X", **more}


def test_dumps_survive_a_restart(spark, tmp_path):
    """The process dies inside the second batch; started again from the checkpoint, nothing is lost and nothing comes twice."""
    src, got = tmp_path / "in", {}
    src.mkdir()
    (src / "1.json").write_text(json.dumps({"articles": [article(1), article(2)]}, indent=2))
    (src / "2.json").write_text(json.dumps([article(3), article(4, title="")]))
    (src / "3.json").write_text(json.dumps({"other": 1}))
    deaths = [1]

    def sink(df, batch):
        rows = df.select("url", "title", "language", "metadata").collect()
        if batch == 1 and deaths:
            deaths.pop()
            raise RuntimeError("killed")
        got[batch] = rows

    def run():
        q = ingest.dumps(spark, str(src)).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    with pytest.raises(Exception, match="killed"):
        run()
    (src / "4.json").write_text(json.dumps({"articles": [article(5, language=None), {"title": "no url"}, article(6, url=""), {**article(7), "seendate": "never"}]}))
    run()
    run()  # nothing is new
    rows = sorted((r.url, r.title, r.language) for b in got.values() for r in b)
    assert rows == [("http://u/1", "title 1", "English"), ("http://u/2", "title 2", "English"), ("http://u/3", "title 3", "English"), ("http://u/4", "Untitled", "English"), ("http://u/5", "title 5", "English")]
    raw = [json.loads(r.metadata) for b in got.values() for r in b]
    assert all(x["sourcecountry"] == "X" for x in raw)


def test_a_document_is_swapped_whole(spark, tmp_path):
    path = f"file://{tmp_path}/report.json"
    sinks.json_document(spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string"), path)
    sinks.json_document(spark.createDataFrame([(3, "c")], "k int, v string"), path)
    assert json.loads(store.text_of(spark, path)) == [{"k": 3, "v": "c"}]
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["report.json"]


def test_safe_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`Merger & Acquisition` int, `Regulatory / Legal` int, other int")
    assert records.with_safe_names(df, ["Merger & Acquisition", "Regulatory / Legal", "absent"], "P_").columns == ["P_MERGER_ACQUISITION", "P_REGULATORY_LEGAL", "other"]
    with pytest.raises(ValueError, match="together"):
        records.with_safe_names(spark.createDataFrame([(1, 2)], "`a b` int, `A B` int"), ["a b", "A B"])


def test_list_literals(spark):
    rows = [("['a', 'b']", ["a", "b"]), ("""["it's", 'so']""", ["it's", "so"]), (r"['it\'s']", ["it's"]), ("[]", []), (" [ 'x,y' , ] ", ["x,y"]), ("['a' 'b']", None), ("'a'", None), ("[a]", None), (None, None), ("['" + "long " * 20_000 + "']", ["long " * 20_000])]
    got = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "k int, t string").select("k", records.list_literal(F.col("t")).alias("x")).orderBy("k").collect()
    assert [r.x for r in got] == [want for _, want in rows]


def test_the_strongest_event(spark):
    kind = "event_id string, entity string, entity_status string, materiality string, impact_score double, event_type string, timestamp string"
    rows = [("e3", "Tesla", "valid", "MATERIAL_EVENT", 8.0, "Credit Event", "2024-01-02"), ("e2", "Tesla", "valid", "MATERIAL_EVENT", 8.0, "Credit Event", "2024-01-01"), ("e1", "Tesla", "valid", "MATERIAL_EVENT", 8.0, "Credit Event", "2024-01-01"), ("x1", "Nobody", "valid", "MATERIAL_EVENT", 9.0, "Credit Event", "2024-01-01"), ("x2", "Tesla", "unresolved_entity", "MATERIAL_EVENT", 9.0, "Credit Event", "2024-01-01"), ("x3", "Tesla", "valid", "MATERIAL_EVENT", 9.0, "Macroeconomic", "2024-01-01"), ("x4", "Tesla", "valid", "NO_EVENT", 9.0, "Credit Event", "2024-01-01")]
    df = spark.createDataFrame(rows, kind)
    assert records.strongest(df, ["Credit Event"], ["Tesla"]).first()["event_id"] == "e1"
    assert records.strongest(df, ["Credit Event"]).first()["event_id"] == "x1"
    with pytest.raises(Exception, match="no event fits"):
        records.strongest(df, ["Credit Event"], ["Ford"]).collect()


def test_observations_take_the_request(spark):
    rows = [(1, " Head ", "body", "e", {"a": "1", "ticker": "OLD"}, "Acme", "T"), (2, None, " ", "e", None, None, None), (3, "h", None, "e", None, "", None), (4, "h", "b", None, {"a": None}, None, "T")]
    df = spark.createDataFrame(rows, "id int, headline string, body string, entity string, metadata map<string,string>, company string, tick string")
    got = {r.id: r for r in records.observations(df, {"company_name": F.col("company"), "ticker": F.col("tick")}, F.col("company")).collect()}
    assert (got[1].text, got[1].entity, got[1].metadata, got[1].reject_reason) == ("Head body", "Acme", {"a": "1", "company_name": "Acme", "ticker": "T"}, None)
    assert (got[2].text, got[2].entity, got[2].metadata, got[2].reject_reason) == ("", "e", None, "no text")
    assert (got[3].entity, got[3].metadata) == ("e", None) and got[4].metadata == {"a": None, "ticker": "T"}


def test_audit_defaults(spark):
    df = spark.createDataFrame([(1, "t", None, "x"), (2, None, "nan", None), (3, "t", "r7", "nan")], "n int, text string, row_id string, label string")
    got = {r.n: (r.row_id, r.label) for r in records.audit_rows(df, "text", "row_id", "n", "label").collect()}
    assert got == {1: ("1", "x"), 2: ("2", "NON_MATERIAL"), 3: ("r7", "NON_MATERIAL")}


def test_credit_contexts(spark):
    rows = [("Acme Bank missed payments on its bond", "STRONG"), ("change the default browser of the bank", "WEAK"), ("someone is insolvent", "WEAK"), (None, "WEAK"), ("she could go bankrupt on her loan", "WEAK"), ("Covenant breach at the issuer", "STRONG")]
    got = spark.createDataFrame(rows, "t string, want string").select("want", rules.credit_context(F.col("t")).alias("got")).collect()
    assert all(r.got == r.want for r in got)


def test_a_record_in_full(spark):
    rows = [(1, "c", 3.0, 0.5, 0.7, "tweet", "first", "Macroeconomic", "Low", 1.0, "d1", "g1"), (2, "c", 9.0, -0.5, 0.6, "news", "second", "Credit Event", "Critical", 0.5, "d2", "g2"), (3, "c", 9.0, 0.3, 0.9, "tweet", None, "Macroeconomic", "Critical", 0.3, "d3", "g3"), (4, "d", 1.0, 0.0, 0.0, None, "only", "Macroeconomic", "Minimal", 1.0, "d4", "g4")]
    df = spark.createDataFrame(rows, "id long, cluster string, impact double, sentiment double, confidence double, source string, text string, kind string, tier string, novelty double, ts string, guard string")
    names = {k: k for k in ("impact", "sentiment", "confidence", "source", "text", "tier", "novelty", "ts", "guard")} | {"event_type": "kind"}
    got = {r.cluster: r for r in clustering.canonical_records(df, ["cluster"], "id", names).collect()}
    c = got["c"]
    assert (c.observation_count, c.impact_score, c.event_confidence, c.source_types, c.representative_id, c.representative_text, c.credit_guard_reason) == (3, 9.0, 0.9, ["news", "tweet"], 2, "second", "g2")
    assert c.sentiment_score == pytest.approx(0.1) and c.source_row_ids == [1, 2, 3] and len(set(c.source_hashes)) == 3
    assert got["d"].source_types == [] and got["d"].credit_guard_reason is None


def test_buckets_with_equal_edges(spark):
    df = spark.createDataFrame([(float(min(k, 3)), float(k)) for k in range(10)] + [(None, 1.0), (1.0, None)], "v double, t double")
    got = {r.bucket: (r["count"], r["mean"], r["median"]) for r in evaluate.bucket_stats(df, "v", "t", 5).collect()}
    assert sum(n for n, _, _ in got.values()) == 10 and got[min(got)][1] < got[max(got)][1]
