import math
import re
from collections import Counter

import numpy as np
import pytest

from subsidia.llm import lexical_search

UPPER = {c: c + 32 for c in range(65, 91)}


def brute(docs, items, k=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(UPPER))
    held = [(i, Counter(w), len(w)) for i, w in ((i, split(t)) for i, t in docs)]
    n_docs, n_terms = sum(n > 0 for *_, n in held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        asked, scored = set(split(text)), []
        for i, c, n in held:
            m = 10 + 90 * n * n_docs // max(1, n_terms)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in asked & c.keys())
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, **options):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, query int, rank int")
    items = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id int, text string, words int")
    return sorted((tuple(r) for r in lexical_search.search(docs, items, **options).collect()), key=str)


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    words = [f"w{int(x)}" for x in rng.zipf(1.3, 40 * n) if x < 5000]
    at = np.sort(rng.integers(0, len(words), n))
    return [(int(rng.integers(0, n)), " ".join(words[a:b])) for a, b in zip(at[:-1], at[1:])]


@pytest.mark.parametrize("options", [{}, {"shard": 200, "most_items": 7}, {"k": 3, "shard": 1}])
def test_search_equals_brute_force(spark, monkeypatch, options):
    """Shards, passes, ties, small blocks and spans."""
    monkeypatch.setattr(lexical_search, "SPANS", 3)
    docs = corpus(400, 1)
    items = [(i % 17, " ".join(t.split()[:30])) for i, t in docs[::20]]
    assert found(spark, docs, items, **options) == brute(docs, items, options.get("k", 10))


def test_search_of_odd_rows(spark):
    """Null and repeated ids, null and empty texts, very long texts, items without terms, characters beyond ASCII."""
    docs = [(1, "the Cat sat"), (1, "the Cat sat"), (None, "the Cat sat"), (2, None), (3, ""), (4, "-- ++"), (5, "Ünï cöde x 猫"), (6, "cat " * 300_000), (7, "dog")]
    items = [(1, "CAT! the"), (1, "cat"), (2, None), (3, "?!"), (None, "ünï 猫 Ünï"), (4, "absent")]
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, [], items) == [] and found(spark, docs, []) == []
    assert found(spark, [(1, None)], items) == []


@pytest.mark.parametrize("widest", [2, 5])
def test_blocks_are_the_cheapest(widest):
    """All divisions of short lists, costed one by one."""
    rng = np.random.default_rng(2)
    lists = [rng.integers(1, 20, n) for n in (1, 7, 3, 9, 2)]
    bounds = np.cumsum([0, *map(len, lists)])
    end = lexical_search.block_ends(np.concatenate(lists), bounds, widest, 2)

    def cost(own, cuts):
        edges = [0, *cuts, len(own)]
        return sum((b - a) * max(own[a:b]) + 2 * own.mean() if b - a <= widest else np.inf for a, b in zip(edges, edges[1:]))

    for own, a, b in zip(lists, bounds, bounds[1:]):
        n = len(own)
        best = min(cost(own, [i + 1 for i in range(n - 1) if mask >> i & 1]) for mask in range(1 << (n - 1)))
        assert end[b - 1] and np.isclose(cost(own, (np.flatnonzero(end[a : b - 1]) + 1).tolist()), best)


def test_blocks_are_skipped(monkeypatch):
    """A span whose bound is below the k-th score is not read."""
    ids = np.arange(1000)
    tfs = np.where(ids < 10, 50, 1)
    shard = lexical_search._Shard(ids, np.zeros(1000, bool), np.full(1000, 60), np.ones(1000, np.int64), np.zeros(1000, np.int64), tfs, np.array([1000]), 1000, 60_000)
    read = []
    monkeypatch.setattr(lexical_search.np, "bincount", lambda which, *a, f=np.bincount: (read.append(len(which)), f(which, *a))[1])
    monkeypatch.setattr(lexical_search, "SPANS", 1)
    docs, _, _ = shard.best(np.array([0]), 10, 0)
    assert docs.tolist() == list(range(10)) and sum(read) < 200
