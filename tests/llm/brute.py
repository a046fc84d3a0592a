"""Plain Python versions of the operators' contracts, for small inputs."""

import hashlib
from collections import Counter, defaultdict

from tidemark.llm.common import FOLD


def words(text):
    return (text or "").encode().split()


def substring(rows, window=35):
    """rows: (doc_id, text) -> list of (doc_id, n_words, n_removed, kept_sha256)."""
    seen = Counter(tuple(w[i : i + window]) for w in (words(t) for _, t in rows) for i in range(len(w) - window + 1))
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def shingle_set(text, size):
    w = (text or "").encode().translate(FOLD).split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)])


def near(rows, size=3, least=85):
    """rows: (doc_id, text) -> {doc_id: (n_shingles, component_id)}; all pairs that share a shingle."""
    sets = [(i, shingle_set(t, size)) for i, t in rows]
    first = {}
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)

    nodes = []
    for i, s in sets:
        if s and s in first:
            join(i, first[s])
        elif s:
            first[s] = i
            nodes.append((i, s))
    often = Counter(g for _, s in nodes for g in s)
    where = defaultdict(list)
    for n, (i, s) in enumerate(nodes):
        rare = sorted(s, key=lambda g: (often[g], g))[: len(s) - -(-least * len(s) // 100) + 1]  # sets this similar share one of these
        for m in {m for g in rare for m in where[g]}:
            j, other = nodes[m]
            if find(i) != find(j):
                both = len(s & other)
                if 100 * both >= least * (len(s) + len(other) - both):
                    join(i, j)
        for g in rare:
            where[g].append(n)
    return {i: (len(s), find(i)) for i, s in sets}
