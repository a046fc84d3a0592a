"""Records rebuilt over splits against one reader of the whole file."""

import csv
import datetime as dt
import io
import random

import pytest

from tidemark.sources import observations, splits


def one_reader(text):
    """Fields are gathered until 13 or 14 are there, at the end of each physical row."""
    held, out = [], []
    for row in csv.reader(io.StringIO(text, newline="")):
        if not row:
            continue
        held += row
        if len(held) >= 13:
            take = 14 if len(held) >= 14 else 13
            out.append(held[:take])
            held = held[take:]
    assert not held
    return out


def messy(seed, n):
    """Records of 13 or 14 fields: quoted fields with line feeds, quotes, commas, and unquoted ones broken over lines."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", 'say "x"', "a,b", "é", "", "line\nfeed", "two\n\nfeeds", "tail\r\nend", ' "mid" quote', "long " * 30])
    out = io.StringIO(newline="")
    write = csv.writer(out, lineterminator="\n")
    for k in range(n):
        fields = [word() for _ in range(13 + (rng.random() < 0.5))]
        fields[2] = "31/01/2017"
        cut = rng.randrange(1, 12) if rng.random() < 0.2 else 0
        if cut and len(fields) == 14 and "" not in (fields[cut - 1], fields[cut]):  # a record over two physical rows
            write.writerow(fields[:cut])
            write.writerow(fields[cut:])
        else:
            write.writerow(fields)
        if k % 17 == 0:
            out.write("\n")  # blank rows don't count
        if rng.random() < 0.05:
            write.writerow([f"wide{j}" for j in range(28)])  # two records of 14, the second at the end of the next row
            write.writerow([f"next{j}" for j in range(14)])
            write.writerow(["z"] * 14)
    return out.getvalue()


def settle(text):
    """Cut the text behind the last place where nothing is pending."""
    held, size, good = 0, 0, 0
    source = io.StringIO(text, newline="")

    def counted():
        nonlocal size
        for line in source:
            size += len(line)
            yield line

    for row in csv.reader(counted()):
        held += len(row)
        if row and held >= 13:
            held = held - 14 if held >= 14 else 0
        if held == 0:
            good = size
    return text[:good]


@pytest.mark.parametrize("seed", [1, 2])
def test_splits_give_what_one_reader_gives(spark, tmp_path, seed):
    texts = {"a.csv": settle(messy(seed, 120)), "b.csv": settle(messy(seed + 10, 40)), "empty.csv": ""}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, newline="")
    size = len(texts["a.csv"].encode())
    for parts in (1, 50):
        got = splits.records(spark, str(tmp_path), max(size // parts, 64))
        rows = sorted((r.file.rsplit("/", 1)[1], r.record, r.fields) for r in got.collect())
        assert rows == [(name, k, f) for name in ("a.csv", "b.csv") for k, f in enumerate(one_reader(texts[name]))]


def test_a_field_over_many_splits(spark, tmp_path):
    long = "\n".join(f"line {k} with words" for k in range(400))
    row = [long, "Ford", "31/01/2017", *"1234567890"]
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator="\n").writerows([row, row])
    (tmp_path / "f.csv").write_text(out.getvalue(), newline="")
    got = splits.records(spark, str(tmp_path / "f.csv"), 500).orderBy("record").collect()
    assert [r.fields for r in got] == [row, row]


def test_what_is_left_over_is_an_error(spark, tmp_path):
    (tmp_path / "bad.csv").write_text(",".join("abcdefghijklm") + "\nleft,over\n")
    with pytest.raises(Exception, match="unparsed trailing fields"):
        splits.records(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "open.csv").write_text(",".join("abcdefghijkl") + ',"never closed\n')
    with pytest.raises(Exception, match="unparsed trailing fields"):
        splits.records(spark, str(tmp_path / "open.csv")).collect()


def test_typed_load(spark, tmp_path):
    rows = [["text one\nsecond line", "Ford", "31/01/2017", "12.5", "", "x", *"3456789"], ["t2", "Acme", "2017-01-31", *["1"] * 10, "who"], ["t3", "Acme", "01/02/2017", *["2"] * 10]]
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator="\n").writerows(rows)
    (tmp_path / "t.csv").write_text(out.getvalue(), newline="")
    got = splits.typed(splits.records(spark, str(tmp_path / "t.csv"))).orderBy("record").collect()
    assert [(r.TWEET, r.STOCK, r.DATE, r.LAST_PRICE, r["1_DAY_RETURN"], r["2_DAY_RETURN"], r.MENTION) for r in got] == [("text one\nsecond line", "Ford", dt.date(2017, 1, 31), 12.5, None, None, None), ("t2", "Acme", None, 1.0, 1.0, 1.0, "who"), ("t3", "Acme", dt.date(2017, 2, 1), 2.0, 2.0, 2.0, None)]
    assert splits.typed(splits.records(spark, str(tmp_path / "t.csv")), 2).count() == 2
    kept = observations.without_leakage(splits.typed(splits.records(spark, str(tmp_path / "t.csv"))))
    assert not set(observations.LEAKAGE) & set(kept.columns) and "LAST_PRICE" in kept.columns
    header = ",".join(observations.COLUMNS) + "\n"
    (tmp_path / "q.csv").write_text(header + out.getvalue().split("t2,")[0], newline="")
    r = observations.read_quoted(spark, str(tmp_path / "q.csv")).first()
    assert r.TWEET == "text one\nsecond line" and r.DATE == dt.date(2017, 1, 31) and r["1_DAY_RETURN"] is None
