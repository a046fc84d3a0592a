"""Toxicity with a linear-chain conditional random field.

Tokens have two tags, clean and toxic.  Labels are given for documents, so tokens are labelled by distant
supervision: in documents marked toxic, a token is toxic if its word or the beginning of its word is far
more frequent there than in the others.  The field learns tag scores from word, prefix and suffix features
and the transitions between tags.  Forward-backward gives each token's marginal; a document's score is a
logistic function of its largest marginal and its expected number of toxic tokens, and runs of tokens
above one half are its offending offsets.

Training reads a bounded sample of labelled documents (``per_class`` and ``class_bytes`` of either class,
chosen by a hash of the id); scoring reads every document whole.

Defined cases: null and empty texts have no tokens and get the score of a document without any sign; words
never seen have the score of their known prefixes and suffixes, or of none; equal rows get equal scores;
ids with several or null labels count as toxic if any label is 1 and are left out if all are null; without
any training row the model calls nothing toxic; equal hashes in the choice of the sample are ordered by id; a
very long text is scored in one task, block by block; an empty table gives an empty result; other columns, whatever
their names, are ignored (``keep_clean`` keeps them).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CACHED, alone, FOLD, mixed, small_batches, utf8

PER_CLASS = 1500
#: Bytes of training texts of either class at most; the texts that would go beyond are left out of the sample.
CLASS_BYTES = 32 << 20
PUNCTUATION = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
LENGTH = 256
#: Training documents handled at a time.
PIECE = 250
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def features(word: bytes) -> list[bytes]:
    w = word.translate(FOLD).strip(PUNCTUATION)
    if not w:
        return [b"none"]
    s = w.decode("utf-8", "replace")
    return [b"w=" + w, *[f"p{n}={s[:n]}".encode() for n in (4, 5, 6) if len(s) > n], *([f"s3={s[-3:]}".encode()] if len(s) > 3 else [])]


@dataclass
class Model:
    weights: dict[bytes, float] = field(default_factory=dict)
    bias: float = -8.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))  # log scores from tag to tag
    document: tuple[float, float, float] = (-4.0, 0.0, 0.0)

    def score(self, top: float, total: float) -> float:
        a, b, c = self.document
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, a + b * top + c * math.log1p(total)))))


class Emissions(dict):
    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: bytes) -> float:
        if len(self) > CACHED:
            self.clear()
        get = self.model.weights.get
        out = self[word] = self.model.bias + sum(get(f, 0.0) for f in features(word))
        return out


def _blocks(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of LENGTH tokens: their documents, their first token, and their number in the document."""
    n = np.maximum(-(-lengths // LENGTH), 0)
    doc = np.repeat(np.arange(len(lengths)), n)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    first = np.repeat(np.cumsum(lengths) - lengths, n) + number * LENGTH
    return doc, first, number


def forward_backward(s: np.ndarray, lengths: np.ndarray, moves: np.ndarray, pairs: bool = False):
    """Marginals of the toxic tag for the tokens of many documents that lie one behind the other.

    Documents are cut into blocks; each block's transfer matrix is found first, so that all blocks run
    side by side and long documents cost no more a token than short ones.  The tag before a document is
    clean.  With ``pairs`` also the expected number of each move."""
    if not len(s):
        return (np.zeros(0), np.zeros((2, 2))) if pairs else np.zeros(0)
    doc, first, number = _blocks(lengths)
    size = np.minimum(LENGTH, np.repeat(np.cumsum(lengths), -(-lengths // LENGTH)) - first)
    nb, top = len(doc), int(size.max())
    place = np.minimum(first[None, :] + np.arange(top)[:, None], len(s) - 1)
    real = np.arange(top)[:, None] < size[None, :]
    e = np.exp(np.clip(s, -50, 50))[place]
    t = np.exp(moves)

    def step(a, k):
        """One token further: a has the tag last."""
        x = np.stack((a[..., 0] * t[0, 0] + a[..., 1] * t[1, 0], (a[..., 0] * t[0, 1] + a[..., 1] * t[1, 1]) * e[k][(slice(None),) + (None,) * (a.ndim - 2)]), axis=-1)
        x = np.where(real[k][(slice(None),) + (None,) * (a.ndim - 1)], x, a)
        return x / x.sum(axis=tuple(range(1, x.ndim)), keepdims=True)

    start = np.zeros((nb, 2))
    start[:, 0] = 1
    behind = np.ones((nb, 2))
    if number.max() > 0:
        whole = np.broadcast_to(np.eye(2), (nb, 2, 2))
        for k in range(top):
            whole = step(whole, k)
        for j in range(1, int(number.max()) + 1):
            b = np.flatnonzero(number == j)
            x = np.einsum("bi,bij->bj", start[b - 1], whole[b - 1])
            start[b] = x / x.sum(axis=1, keepdims=True)
        for j in range(int(number.max()) - 1, -1, -1):
            b = np.flatnonzero((number == j) & (np.append(doc[1:], -1) == doc))
            x = np.einsum("bij,bj->bi", whole[b + 1], behind[b + 1])
            behind[b] = x / x.sum(axis=1, keepdims=True)
    alpha = np.empty((top + 1, nb, 2))
    alpha[0] = start
    for k in range(top):
        alpha[k + 1] = step(alpha[k], k)
    beta = behind
    p, moved = np.empty((top, nb)), np.zeros((2, 2))
    for k in range(top - 1, -1, -1):
        both = alpha[k + 1] * beta
        p[k] = both[:, 1] / both.sum(axis=1)
        out = np.stack((beta[:, 0], beta[:, 1] * e[k]), axis=1)
        if pairs:
            xi = alpha[k][:, :, None] * t * out[:, None, :]
            moved += (xi / xi.sum(axis=(1, 2), keepdims=True))[real[k]].sum(axis=0)
        x = out @ t.T
        beta = np.where(real[k][:, None], x / x.sum(axis=1, keepdims=True), beta)
    marginal = np.empty(len(s))
    marginal[place[real]] = p[real]
    return (marginal, moved) if pairs else marginal


def _ratio(k1: int, n1: int, k0: int, n0: int) -> float:
    """The G statistic of two frequencies."""
    part = lambda k, n, q: (k * math.log(k / (n * q)) if k else 0.0) + ((n - k) * math.log((n - k) / (n * (1 - q))) if n > k else 0.0)
    q = (k1 + k0) / (n1 + n0)
    return 2 * (part(k1, n1, q) + part(k0, n0, q)) if 0 < q < 1 else 0.0


def _counts(token: np.ndarray, lengths: np.ndarray, label: np.ndarray, size: np.ndarray, which: np.ndarray, n_features: int) -> np.ndarray:
    """Clean and toxic documents of each feature. A word between the same neighbours counts in the first
    document only: copies of a document say nothing new. ``size`` and ``which`` list the features of the words."""
    doc, start = np.repeat(np.arange(len(lengths)), lengths), np.zeros(len(token) + 1, bool)
    start[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    start[-1] = True
    ahead = np.where(start[:-1], 0, np.concatenate(([0], token[:-1] + 1)))
    behind = np.where(start[1:], 0, np.concatenate((token[1:] + 1, [0])))
    context = mixed(mixed(mixed(ahead.astype(np.uint64) + np.uint64(1)) + token.astype(np.uint64)) + behind.astype(np.uint64))
    del ahead, behind, start
    order = np.argsort(context, kind="stable")  # equal contexts side by side, the first document's ahead
    context, place = context[order], doc[order]
    head = np.concatenate(([True], context[1:] != context[:-1]))[: len(context)]
    fresh = np.zeros(len(token), bool)
    fresh[order] = place == place[head][np.cumsum(head) - 1]
    del order, context, place, head
    pair = np.unique(doc[fresh] * len(size) + token[fresh])
    first, out = np.cumsum(size) - size, np.zeros((2, n_features), np.int64)
    for lo in range(0, len(lengths), PIECE):
        some = pair[np.searchsorted(pair, lo * len(size)) : np.searchsorted(pair, (lo + PIECE) * len(size))]
        d, w = np.divmod(some, max(len(size), 1))
        n = size[w]
        at = np.repeat(first[w] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        d, f = np.divmod(np.unique(np.repeat(d, n) * n_features + which[at]), max(n_features, 1))
        for c in (0, 1):
            out[c] += np.bincount(f[label[d] == c], minlength=n_features)
    return out


def _in_pieces(s: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over a few documents at a time, to bound the driver's memory."""
    p, moved, at = np.empty(len(s)), np.zeros((2, 2)), 0
    for lo in range(0, len(lengths), 2 * PIECE):
        some = lengths[lo : lo + 2 * PIECE]
        p[at : at + some.sum()], m = forward_backward(s[at : at + some.sum()], some, moves, pairs=True)
        moved, at = moved + m, at + int(some.sum())
    return p, moved


def train(texts: list[bytes], toxic: list[int], rounds: int = 40, l2: float = 0.02) -> Model:
    """Fit the field and the document score on labelled documents (in the driver's memory, bounded by the sample)."""
    model = Model()
    if not texts or sum(toxic) == 0:
        return model
    # Work on numbers of distinct words: the sample's tokens may be many, its words are few.
    number: dict[bytes, int] = {}
    token = np.fromiter((number.setdefault(w, len(number)) for t in texts for w in _WORD.findall(t)), np.int64)
    lengths = np.array([len(_WORD.findall(t)) for t in texts])
    label = np.array(toxic)
    known: dict[bytes, int] = {}
    of_word = [[known.setdefault(f, len(known)) for f in features(w)] for w in number]
    size = np.array([len(fs) for fs in of_word], np.int64)
    where, which = np.repeat(np.arange(len(number)), size), np.array([f for fs in of_word for f in fs], np.int64)
    counts = _counts(token, lengths, label, size, which, len(known))
    n = [max(len(toxic) - sum(toxic), 1), max(sum(toxic), 1)]
    # A likelihood-ratio test of document frequencies against equal frequency, at a level for as many tests as there are features.
    level = 2 * math.log(max(int((counts[1] > 0).sum()), 2)) + 4
    often = np.flatnonzero((counts[1] >= 3) & (counts[1] / n[1] > 5 * counts[0] / n[0]))
    sign = np.zeros(len(known), bool)
    sign[[f for f in often.tolist() if _ratio(int(counts[1][f]), n[1], int(counts[0][f]), n[0]) > level]] = True
    y = (np.bincount(where, sign[which], len(number)) > 0)[token] * np.repeat(label, lengths).astype(float)
    before = np.concatenate(([0.0], y[:-1]))
    before[(np.cumsum(lengths) - lengths)[lengths > 0]] = 0
    seen = np.array([[((before == i) & (y == j)).sum() for j in (0, 1)] for i in (0, 1)], float)
    w, bias, moves = np.zeros(len(known)), -4.0, np.zeros((2, 2))
    gw, gb, gm = np.full(len(known), 1e-8), 1e-8, np.full((2, 2), 1e-8)
    for _ in range(rounds):
        s = np.bincount(where, w[which], len(number))[token] + bias
        p, moved = _in_pieces(s, lengths, moves)
        d = y - p
        slope = np.bincount(which, np.bincount(token, d, len(number))[where], len(known)) - l2 * w
        gw += slope**2
        w += 0.8 * slope / np.sqrt(gw)
        gb += d.sum() ** 2
        bias += 0.8 * d.sum() / math.sqrt(gb)
        change = seen - moved
        gm += change**2
        moves += 0.3 * change / np.sqrt(gm)
        moves -= moves[0, 0]
    s = np.bincount(where, w[which], len(number))[token] + bias
    p, _ = _in_pieces(s, lengths, moves)
    big = np.abs(w) > 1e-3
    model = Model({f: float(w[k]) for f, k in known.items() if big[k]}, float(bias), moves)
    at = np.cumsum(lengths)
    x = np.array([[1, p[b - k : b].max() if k else 0.0, math.log1p(p[b - k : b].sum())] for b, k in zip(at, lengths, strict=True)])
    t, c = np.array(toxic, float), np.array([-4.0, 4.0, 1.0])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        h = (x * (q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(3)
        c = c + np.linalg.solve(h, x.T @ (t - q) - 0.05 * c)
    model.document = tuple(float(v) for v in c)
    return model


def is_held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS, class_bytes: int = CLASS_BYTES) -> tuple[list[bytes], list[int]]:
    """At most ``per_class`` labelled training documents of either class, chosen by a hash of the id, and at most
    ``class_bytes`` of their texts.  A text of more than an eighth of that is left out by itself; a class that has
    labelled texts and ends without any is an error."""
    label = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).filter("id is not null and y is not null").filter(~is_held_out("id"))
    label = label.groupBy("id").agg(F.max("y").alias("y"))
    some = [label.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class) for y in (0, 1)]
    chosen = F.broadcast(some[0].union(some[1]))  # 2 * per_class rows at most
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id").groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    line = Window.partitionBy("y").orderBy(F.xxhash64("id"), "id")  # 2 * per_class rows at most
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    fits = size <= class_bytes // 8
    rows = rows.withColumn("fits", fits & (F.sum(F.when(fits, size).otherwise(0)).over(line) <= class_bytes))
    every = rows.select("id", "y", "fits", F.when(F.col("fits"), F.col("text")).alias("text")).collect()
    got = sorted((r for r in every if r["fits"]), key=lambda r: str(r["id"]))
    if lost := {r["y"] for r in every} - {r["y"] for r in got}:
        raise ValueError(f"all labelled texts of class {sorted(lost)} are longer than {class_bytes // 8} bytes")
    return [(r["text"] or "").encode() for r in got], [int(r["y"]) for r in got]


_loaded: list[Emissions] = []


def _emissions(model: Model) -> Emissions:
    """The token scores of a model, kept for the next batch."""
    if not _loaded or _loaded[0].model is not model:
        _loaded[:] = [Emissions(model)]
    return alone(_loaded[0])


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        emit = _emissions(model)
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))
        for batch in batches:
            texts = utf8(batch.column(1))
            docs = [t.split() for t in texts]
            lengths = np.array([len(d) for d in docs], np.int64)
            s = np.fromiter((emit[w] for d in docs for w in d), float, int(lengths.sum()))
            p = forward_backward(s, lengths, model.moves)
            scores, spans, at = [], [], 0
            for text, n in zip(texts, lengths.tolist(), strict=True):
                m = p[at : at + n]
                at += n
                scores.append(model.score(float(m.max()) if n else 0.0, float(m.sum())))
                spans.append(_offsets(text, m) if n and m.max() >= 0.5 else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, spans_type)], ["id", "score", "spans"])

    return run


def _offsets(text: bytes, marginal: np.ndarray) -> list[dict]:
    """Character offsets of the runs of toxic tokens, with the largest marginal of each."""
    out: list[dict] = []
    chars = None if text.isascii() else np.concatenate(([0], np.cumsum(np.frombuffer(text, np.uint8) & 0xC0 != 0x80)))
    last = -2
    for k, m in enumerate(_WORD.finditer(text)):
        if marginal[k] >= 0.5:
            a, b = m.span() if chars is None else (int(chars[x]) for x in m.span())
            if last == k - 1:
                out[-1]["end"] = b
                out[-1]["marginal"] = max(out[-1]["marginal"], float(marginal[k]))
            else:
                out.append({"start": a, "end": b, "marginal": float(marginal[k])})
            last = k
    return out


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a record: id, score, spans (character offsets of toxic runs)."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_scored(shared), f"id {kind}, score double, spans array<struct<start:bigint,end:bigint,marginal:double>>")


def _clean(shared, text_at: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scored(shared)
        for batch in batches:
            pair = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column(text_at)], ["id", "text"])
            for got in score([pair]):
                yield batch.filter(pa.array([s < threshold for s in got.column("score").to_pylist()], pa.bool_()))

    return run


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose score is below ``threshold``."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_clean(shared, docs.columns.index(text_col), threshold), docs.schema)
