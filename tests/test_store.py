"""The gate's fit, tables that change together, the ledger of chunks, and checks inside the write."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import gate
from tidemark.sources import ledger, store


def newton(x, y, c=1.0, balanced=True):
    """The minimum of c * sum of weighted losses + |w|^2 / 2, by Newton's method; the intercept is free."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum())) if balanced else np.ones(len(y))
    b, pull = np.zeros(a.shape[1]), np.append(np.ones(x.shape[1]), 0.0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ b))
        b = b - np.linalg.solve((a.T * (c * w * p * (1 - p))) @ a + np.diag(pull), c * a.T @ (w * (p - y)) + pull * b)
    return b


@pytest.mark.parametrize(("c", "balanced"), [(1.0, True), (0.3, False)])
def test_fit(spark, c, balanced):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=400) > 1.2).astype(int)
    rows = [(k, [float(v) for v in x[k]], int(y[k])) for k in range(400)] + [(900, None, 1), (901, [1.0] * 5, None), (902, [1.0] * 5, 7)]
    df = spark.createDataFrame(rows, "id int, v array<float>, y int")
    x32 = x.astype(np.float32).astype(float)
    g, want = gate.fit(df, "v", "y", c, balanced), newton(x32, y, c, balanced)
    assert np.allclose([*g.coefficients, g.intercept], want, atol=1e-5)
    p = {r.id: r.p for r in df.select("id", g.probability(F.col("v")).alias("p")).collect()}
    assert p[900] == 0.0 and all(p[k] == pytest.approx(1 / (1 + np.exp(-(x32[k] @ want[:-1] + want[-1]))), abs=1e-5) for k in range(400))
    assert gate.Gate.of(g.table(spark)) == g
    assert df.select(g.probability(F.array(F.lit(1.0))).alias("p")).first().p == 0.0  # another length


def test_no_gate_without_two_classes(spark):
    df = spark.createDataFrame([([1.0], 1), ([2.0], 1)], "v array<double>, y int")
    for rows in (df, df.limit(0)):
        g = gate.fit(rows, "v", "y")
        assert g == gate.Gate() and df.select(g.probability(F.col("v")).alias("p")).first().p == 0.0


def test_sweep(spark):
    rng = np.random.default_rng(1)
    s, y = rng.random(200).round(2), rng.integers(0, 2, 200)
    cuts = [0.1, 0.5, 0.9, 2.0]
    df = spark.createDataFrame([*zip(s.tolist(), y.tolist(), strict=True), (None, 1), (0.7, None)], "s double, y int")
    got = {r.threshold: r for r in gate.sweep(df, "s", "y", cuts).collect()}
    for t in cuts:
        tp, fp, fn, tn = ((s >= t) & (y == 1)).sum(), ((s >= t) & (y == 0)).sum(), ((s < t) & (y == 1)).sum(), ((s < t) & (y == 0)).sum()
        r = got[t]
        assert (r.tp, r.fp, r.fn, r.tn) == (tp, fp, fn, tn)
        assert r.precision == (tp / (tp + fp) if tp + fp else 0.0) and r.f1 == pytest.approx(2 * tp / (2 * tp + fp + fn) if tp else 0.0)
    assert gate.best_threshold(gate.sweep(df, "s", "y", cuts), 0.99) == 0.1
    assert gate.best_threshold(gate.sweep(df.limit(0), "s", "y", cuts), 0.5) == 0.1


def test_tables_change_together(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    a, b = spark.range(5), spark.range(3).toDF("k")
    assert s.read("a", "id long").count() == 0
    assert s.commit({"a": a, "b": b})["version"] == 1
    old = s.read("a")
    with pytest.raises(store.Rejected) as e:  # the first table is fine, the second stops the commit of both
        s.commit({"a": a.union(a), "b": b}, {"b": {"small": F.col("k") < 2}})
    assert e.value.found == {"small": 2} and s.current()["version"] == 1 and s.read("a").count() == 5

    def dies(spark_, path, text):
        raise OSError("stopped before the swap")

    whole, store.swap = store.swap, dies
    try:
        with pytest.raises(OSError, match="stopped"):
            s.commit({"a": a.limit(1), "b": b.limit(1)})
    finally:
        store.swap = whole
    assert (s.read("a").count(), s.read("b").count()) == (5, 3)
    assert s.vacuum() == 2 and old.count() == 5
    assert s.commit({"b": b.union(b)}, {"b": {"null": F.col("k").isNull()}})["tables"]["b"]["rows"] == 6
    assert (s.read("a").count(), s.read("b").count()) == (5, 6)


def test_a_second_writer_is_noticed(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    s.commit({"a": spark.range(1)})

    first = store.written

    def meanwhile(df, path, checks=None):
        store.written = first
        s.commit({"a": spark.range(2)})
        return first(df, path, checks)

    store.written = meanwhile
    try:
        with pytest.raises(RuntimeError, match="first"):
            s.commit({"a": spark.range(9)})
    finally:
        store.written = first
    assert s.read("a").count() == 2


def test_checks_cost_no_second_scan(spark, tmp_path):
    """The source is read once: a counting accumulator sees every row a single time."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(0, 1000, 1, 4).mapInArrow(count, "id long")
    n = store.written(df, f"file://{tmp_path}/t", {"odd": F.col("id") % 2 == 1, "none": F.lit(False)})
    assert n == {"rows": 1000, "odd": 500, "none": 0} and seen.value == 1000


class Killed(BaseException):
    """Ends a run as a signal would: nothing behind it is done."""


def test_a_run_goes_on_where_it_stopped(spark, tmp_path):
    df = spark.range(1000).select("id", (F.col("id") * 3).alias("x"))
    step = lambda rows: rows.filter("id % 2 = 0").select("id", "x")
    chunks = ledger.ranges(df, "id", 250)
    assert chunks == [(0, 250), (250, 500), (500, 750), (750, 1000)]
    led = ledger.Ledger(spark, f"file://{tmp_path}/run", {"code": "1"})

    def dies(chunk):
        if chunk.startswith(f"{500:020d}"):
            raise Killed

    with pytest.raises(Killed):
        led.run(df, "id", chunks, step, before_commit=dies)
    assert [r["status"] for r in led.records()] == ["COMPLETE", "COMPLETE", "IN_PROGRESS"]
    assert led.read("id long, x long").count() == 250  # what was half-written isn't seen
    done = {r["chunk_id"]: r["path"] for r in led.done()}
    store.swap(spark, f"file://{tmp_path}/run/ledger/{0:020d}-{250:020d}.json", "{ broken")  # a record that can't be read counts as none
    again = ledger.Ledger(spark, f"file://{tmp_path}/run", {"code": "1"})
    assert again.run(df, "id", chunks, step) == [f"{s:020d}-{e:020d}" for s, e in (chunks[0], chunks[2], chunks[3])]
    assert {r["chunk_id"]: r["path"] for r in again.done()}[f"{250:020d}-{500:020d}"] == done[f"{250:020d}-{500:020d}"]
    assert sorted(tuple(r) for r in again.read("id long, x long").collect()) == [(k, 3 * k) for k in range(0, 1000, 2)]
    assert all(len(list(p.iterdir())) == 1 for p in (tmp_path / "run/data").iterdir())  # attempts that don't count are gone
    assert again.run(df, "id", chunks, step) == []
    t = ledger.throughput(again.table()).first()
    assert (t.chunks, t.input_rows, t.output_rows) == (4, 1000, 500) and t.rows_per_s > 0
    assert len(ledger.Ledger(spark, f"file://{tmp_path}/run", {"code": "2"}).run(df, "id", chunks, step)) == 4


def test_a_step_that_fails_is_recorded(spark, tmp_path):
    led = ledger.Ledger(spark, f"file://{tmp_path}/run")
    bad = lambda rows: rows.select(F.raise_error(F.lit("no luck")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no luck"):
        led.run(spark.range(10), "id", [(0, 10)], bad)
    r = led.table().first()
    assert r.status == "FAILED" and "no luck" in r.error and led.read("id long").count() == 0
    assert json.loads(r.versions) == {} and ledger.ranges(spark.range(0), "id", 5) == []
    assert led.run(spark.range(10), "id", [(0, 10)], lambda rows: rows) and led.read("id long").count() == 10
