"""Promotion in order against a plain loop, in one commit, and the funnel's signals."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ingest, promotion
from tidemark.sources import store

BATCH = "seq long, run_id string, mode string, status string, signals array<string>, results array<string>"


def plain(batch, runs, events, fixtures):
    """One candidate after the other; what an earlier one took is taken."""
    runs, events, taken, out = set(runs), dict(events), set(), {}
    for seq, run, mode, status, signals, results in sorted(batch):
        if status != "COMPLETED":
            out[seq] = "rejected: status"
        elif signals is None or results is None:
            out[seq] = "rejected: shape"
        elif run in runs:
            out[seq] = "already promoted"
        elif len(signals) != len(results):
            out[seq] = "rejected: mismatch"
        elif any(e in fixtures or (e in events and events[e] != mode) for e in signals):
            out[seq] = "rejected: collision"
        elif signals != results:
            out[seq] = "rejected: mismatch"
        elif set(signals) & taken:
            out[seq] = "rejected: collision"
        else:
            out[seq] = "promoted"
            runs.add(run)
            taken |= set(signals)
    return out


def test_a_batch_is_settled_in_order(spark):
    rng = random.Random(8)
    ids = [f"e{k}" for k in range(60)]
    batch = []
    for seq in range(120):
        signals = rng.choices(ids, k=rng.randrange(0, 4)) if rng.random() > 0.05 else None
        results = signals if rng.random() > 0.1 else rng.choices(ids, k=rng.randrange(0, 4))
        batch.append((seq, f"r{rng.randrange(90)}", rng.choice(["live", "replay"]), "COMPLETED" if rng.random() > 0.1 else "FAILED", signals, results))
    runs, events, fixtures = ["r1", "r2"], {"e3": "live", "e4": "replay"}, ["e5"]
    df = lambda rows, kind: spark.createDataFrame(rows, kind)
    got = promotion.settled(df(batch, BATCH), df([(r,) for r in runs], "run_id string"), df(list(events.items()), "event_id string, mode string"), df([(f,) for f in fixtures], "event_id string"))
    out = {r.seq: r.outcome for r in got.collect()}
    assert out == plain(batch, runs, events, fixtures)
    assert set(out.values()) == {"promoted", "already promoted", "rejected: status", "rejected: shape", "rejected: mismatch", "rejected: collision"}


def test_two_candidates_for_one_signal(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/p")
    none = spark.createDataFrame([], "event_id string")
    rows = [(2, "b", "live", "COMPLETED", ["x"], ["x"]), (1, "a", "live", "COMPLETED", ["x", "y"], ["x", "y"]), (3, "c", "live", "COMPLETED", ["z"], ["z"])]
    first = {r.seq: r.outcome for r in promotion.promote(s, spark.createDataFrame(rows, BATCH), none).collect()}
    assert first == {1: "promoted", 2: "rejected: collision", 3: "promoted"}
    again = promotion.promote(s, spark.createDataFrame([*rows[:1], (4, "a", "live", "COMPLETED", ["q"], ["q"]), (5, "d", "replay", "COMPLETED", ["z"], ["z"])], BATCH), none)
    assert {r.seq: r.outcome for r in again.collect()} == {2: "promoted", 4: "already promoted", 5: "rejected: collision"}  # x goes to the new run of its mode
    assert sorted((r.event_id, r.run_id) for r in s.read("promoted_events").collect()) == [("x", "b"), ("y", "a"), ("z", "c")]
    assert s.read("promoted_runs").count() == 3


def test_a_crash_between_the_tables_changes_neither(spark, tmp_path, monkeypatch):
    s = store.Store(spark, f"file://{tmp_path}/p")
    none = spark.createDataFrame([], "event_id string")
    one = [(1, "a", "live", "COMPLETED", ["x"], ["x"])]
    promotion.promote(s, spark.createDataFrame(one, BATCH), none)
    whole, calls = store.written, []

    def dies(df, path, checks=None):
        calls.append(path)
        if "promoted_events" in path:
            raise OSError("stopped")
        return whole(df, path, checks)

    monkeypatch.setattr(store, "written", dies)
    with pytest.raises(OSError, match="stopped"):
        promotion.promote(s, spark.createDataFrame([(2, "b", "live", "COMPLETED", ["y"], ["y"])], BATCH), none)
    monkeypatch.undo()
    assert any("promoted_runs" in p for p in calls)
    assert [r.run_id for r in s.read("promoted_runs").collect()] == ["a"] and s.read("promoted_events").count() == 1


def test_signals_of_domain_and_themes(spark):
    rows = [(" UK.Reuters.com ", None, "TAX_FNCACT_CEO; X"), ("", " reuters.com", None), (None, "Reuters", '["other", " econ_stockmarket "]'), ("notreuters.com", "reuters.com", "OTHER"), (None, None, "")]
    df = spark.createDataFrame(rows, "d string, p string, t string")
    got = df.select(ingest.domain_signal(F.col("d"), F.col("p")).alias("d"), ingest.theme_signal(F.col("t")).alias("t")).collect()
    assert [(r.d, r.t) for r in got] == [(True, True), (True, False), (False, True), (False, False), (False, False)]
    raw = ['{"V2Themes": "ECON_X;Y", "themes": "none"}', '{"V2Themes": ["a", "ECON_X"]}', '{"url": "u"}', "", None]
    got = spark.createDataFrame([(r,) for r in raw], "m string").select(ingest.raw_theme_signal(F.col("m")).alias("t")).collect()
    assert [r.t for r in got] == [False, True, False, False, False]
