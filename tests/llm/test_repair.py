"""Conversation repair against a search over all edits."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.test_operators import table  # noqa: F401
from tidemark.llm import queries, repair

GOOD = re.compile(r"(s?(ua)+)?\Z")
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def search(turns):
    """(cost, audit, [(role, text)]) of the cheapest edits: turns are (role, text, dead, cut). The best way into each
    state of the grammar, turn by turn; ways of equal cost are compared by their letters."""

    def inserts(best):
        for _ in range(3):
            for q, (c, a, out) in list(best.items()):
                for r in ("user", "assistant"):
                    put(best, NEXT.get((q, r[0])), (c + 5, a + "I", [*out, (r, "")]))
        return best

    def put(best, q, way):
        if q is not None and (q not in best or way[:2] < best[q][:2]):
            best[q] = way

    best = inserts({"": (0, "", [])})
    for role, text, dead, cut in turns:
        now = {}
        for q, (c, a, out) in best.items():
            put(now, q, (c + 2, a + "D", out))
            if not dead:
                if role:
                    put(now, NEXT.get((q, role[0])), (c + 5 * cut, a + "K", [*out, (role, text)]))
                for r in ("user", "assistant"):
                    put(now, NEXT.get((q, r[0])), (c + 1 + 5 * cut, a + "R", [*out, (r, text)]))
        best = inserts(now)
    return min(best[q] for q in ("", "a") if q in best)


def every_edit(turns, most):
    """(cost, audit) by trying all edit sequences up to a cost."""
    found = []

    def go(k, cost, audit, initials):
        if cost > most:
            return
        if k == len(turns) and GOOD.match(initials):
            found.append((cost, audit))
        if len(initials) > 2 * len(turns) + 2:
            return
        for r in "ua":
            go(k, cost + 5, audit + "I", initials + r)
        if k < len(turns):
            role, _, dead, cut = turns[k]
            go(k + 1, cost + 2, audit + "D", initials)
            if not dead:
                go(k + 1, cost + 5 * cut, audit + "K", initials + role[0])
                for r in "ua":
                    go(k + 1, cost + 1 + 5 * cut, audit + "R", initials + r)

    go(0, 0, "", "")
    return min(found)


def coded(turns):
    return np.array([{"s": 1, "u": 2, "a": 3}.get(r[:1], 0) | 4 * dead | 8 * (cut and not dead) for r, _, dead, cut in turns], np.int8)


TURN = st.tuples(st.sampled_from(["system", "user", "assistant", "tool"]), st.just("x"), st.sampled_from([False, False, False, True]), st.sampled_from([False, False, True]))


@settings(max_examples=300, deadline=None)
@given(st.lists(TURN, max_size=40))
def test_cheapest_edits(turns):
    assert repair.cheapest(coded(turns)) == search(turns)[:2]


@settings(max_examples=60, deadline=None)
@given(st.lists(TURN, max_size=4))
def test_search_against_every_edit(turns):
    cost, audit, _ = search(turns)
    assert every_edit(turns, cost) == (cost, audit)


def expected(rows):
    convs, turns = {}, defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv] = None
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        for _ in range((k != 0) + (k == 3)):
            turns[conv].append((turn, "user" if k == 4 else role, text))
    out = []
    for conv in convs:
        line = sorted(turns[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        known = [t for t, _, _ in line if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        seen, n, judged = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
        for _, role, text in line:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            judged.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(line, line[1:], strict=False))
        cost, audit, kept = search(judged)
        out.append((conv, gaps, *n.values(), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_tables(spark, tmp_path):
    rng = random.Random(4)
    words = ["Yes.", "no", "  ", "", None, "Is it?\n", "Fine!  ", "a long, long text.\nwith lines.", "é?", "x. "]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randrange(0, 9)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", None, ""]) if conv is None or conv % 3 else "user assistant".split()[turn % 2]
            rows.append((conv, None if rng.random() < 0.1 else turn * rng.choice([1, 1, 1, 3]), role, rng.choice(words) if conv is None or conv % 2 else f"text {turn}."))
    rows += [(1000, k, "user assistant".split()[k % 2], f"turn {k}{'.' * (k % 7 > 0)}") for k in range(30_000)]  # a third and more of all rows
    rows += [(2000, 1, "user", "same."), (2000, 1, "user", "same."), (2000, 2, "assistant", "x" * 300_000 + ".")]
    rows += [(next(c for c in range(3000, 9000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0), 0, "user", "gone.")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, conv int")
    for name, part in (("all", df), ("none", df.limit(0))):
        part.repartition(3).write.parquet(str(tmp_path / name / "conversations.parquet"))
    got = queries.op13_repair(spark, str(tmp_path / "all"))
    assert got.columns == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(rows)
    assert queries.op13_repair(spark, str(tmp_path / "none")).count() == 0


def test_repaired_turns_follow_the_grammar(spark):
    rows = [(1, 0, "user", "a."), (1, 1, "user", "b."), (1, 2, "assistant", "c."), (2, 0, "assistant", "d.")]
    df = spark.createDataFrame(rows, "conv long, turn long, role string, text string")
    turns = repair.repaired(df, repair.decisions(df)).orderBy("conv", "place").collect()
    assert [(r.conv, r.place, r.edit, r.turn, r.role, r.text) for r in turns] == [(1, 0, "K", 1, "user", "b."), (1, 1, "K", 2, "assistant", "c.")]
    text = df.withColumn("conv", df.conv.cast("string"))
    assert repair.decisions(text).schema["conv"].dataType.simpleString() == "string"
