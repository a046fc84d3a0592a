import hashlib
import random

import corpus_pipeline
from tests.llm import brute
from tidemark.llm import bpe, mixing, stages
from tidemark.llm.queries import vocabulary


def test_stages_on_a_small_corpus(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == names
            docs = spark.createDataFrame(out.toPandas(), docs.schema)
    n = {r["doc_id"]: r["n_tokens"] for r in out.collect()}
    assert len(n) > 0 and all(x >= 0 for x in n.values())


def test_near_dedup_keeps_different_texts_of_one_id(spark):
    words = lambda name: " ".join(f"{name}{j}" for j in range(60))
    texts = [(1, words("a")), (1, words("b")), (1, words("b")), (2, words("b") + " more"), (None, words("c")), (None, words("d")), (None, words("d") + " more"), (None, None), (None, ""), (None, ""), (3, None), (3, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in stages.near_dedup(spark, docs, "").collect()]
    either = [r for r in got if r in ((None, words("d")), (None, words("d") + " more"))]
    assert len(either) == 1
    rest = [(1, words("a")), (1, words("b")), (None, words("c")), (None, None), (None, ""), (3, None), (3, "")]
    assert sorted((r for r in got if r not in either), key=repr) == sorted(rest, key=repr)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept_text string, row int, ids string"


def corpus(spark):
    """Clean documents, exact and near copies, shared passages, nulls, repeats, a long text, clashing names."""
    rng = random.Random(8)
    passage = " ".join(f"shared{k}" for k in range(60))
    texts = [(i, " ".join(f"c{rng.randrange(3000)}" for _ in range(120))) for i in range(60)]
    texts += [(100 + i, texts[i][1]) for i in range(5)] + [(110 + i, texts[i][1] + " more") for i in range(5, 9)]
    texts += [(120 + i, f"own{i} {texts[20 + i][1]} {passage} end{i}") for i in range(4)]
    texts += [(200, None), (201, ""), (None, "no id"), (202, "few words"), texts[0], texts[30], (203, " ".join(f"long{k}" for k in range(30_000)))]
    rows = [(i, t, "en", "abc"[n % 3], len(t or ""), "clash", n, "clash") for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def test_stages_keep_what_they_should(spark, tmp_path):
    docs = corpus(spark)
    rows = docs.collect()
    near = stages.near_dedup(spark, docs, "")
    assert near.columns == docs.columns
    kept = near.collect()
    first = brute.near([(k, r["text"]) for k, r in enumerate(rows)], size=5, least=80)
    groups = {}
    for k, r in enumerate(rows):
        groups.setdefault(first[k][1], []).append(r)
    for group in groups.values():  # one document of each group, with the smallest id
        ids = [r["doc_id"] for r in group if r["doc_id"] is not None]
        assert [r["doc_id"] for r in kept if r in group] == [min(ids, default=None)]
    assert len(kept) == len(groups)

    cut = stages.substring_dedup(spark, docs, "")
    assert cut.columns == docs.columns and cut.schema == docs.schema
    expected = brute.substring([(r["doc_id"], r["text"]) for r in rows])
    texts = []
    for r, (i, n, gone, sha) in zip(rows, expected, strict=True):
        texts.append((i, sha if gone else hashlib.sha256((r["text"] or "").encode()).hexdigest(), r["text"] is None, r["row"], r["kept_text"]))
    got = [(r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest(), r["text"] is None, r["row"], r["kept_text"]) for r in cut.collect()]
    assert sorted(got, key=repr) == sorted(texts, key=repr)
    assert all(r["n_chars"] == len(r["text"] or "") for r in cut.collect())

    mixed = stages.mix_sources(spark, docs, "")
    assert mixed.columns == docs.columns
    size = lambda r: len(brute.words(r["text"]))
    rows_by_source = {s: [r for r in rows if r["source"] == s] for s in "abc"}
    target = {x["source"]: x["target"] for x in mixing.plan(docs).select("source", "target").distinct().collect()}
    for s, of in rows_by_source.items():
        assert abs(sum(size(r) for r in mixed.collect() if r["source"] == s) - target[s]) <= max(map(size, of))

    codec = bpe.codec(vocabulary())
    got = sorted(((r["doc_id"], r["n_tokens"], codec.decode_bytes(bytes(r["ids"])).decode()) for r in stages.encode(spark, docs, "").collect()), key=repr)
    assert [(i, t) for i, _, t in got] == [(i, t) for i, _, t in sorted(((r["doc_id"], len(codec.encode([r["text"] or ""])[0]) // 2, r["text"] or "") for r in rows), key=repr)]


def test_toxic_documents_go_and_clean_ones_stay(spark, tmp_path):
    rng = random.Random(3)
    clean = [" ".join(f"c{rng.randrange(400)}" for _ in range(60)) for _ in range(300)]
    toxic = [" ".join([f"c{rng.randrange(400)}" for _ in range(30)] + ["vile", "scum"] * 3 + [f"c{rng.randrange(400)}" for _ in range(30)]) for _ in range(300)]
    rows = [(k, t, "en", "a", len(t), "clash", 1, "clash") for k, t in enumerate(clean + toxic)] + [(None, None, None, None, None, None, None, None), (9000, "", "en", "a", 0, "x", 1, "x")]
    spark.createDataFrame([(k, 1, int(k >= 300)) for k in range(600)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, SCHEMA)
    got = stages.remove_toxic(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert sum(i is not None and 300 <= i < 600 for i in ids) <= 6 and sum(i is not None and i < 300 for i in ids) >= 298
    assert None in ids and 9000 in ids


def test_stages_take_an_empty_table(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, d).count() == 0


def test_the_library_does_not_import_the_subpackage():
    import pathlib

    root = pathlib.Path(corpus_pipeline.__file__).parent / "tidemark"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text()
