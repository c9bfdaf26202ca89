import math
from collections import Counter

import numpy as np
import pytest

from stratalore.llm import ranked_search as r

DOCS = "doc_id long, text string, item_id int, score string"
ITEMS = "item_id int, text string, doc_id string"


def brute(docs, items, k=10):
    bags = [(i, Counter(r.terms_of(t))) for i, t, *_ in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    total, length = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text, *_ in items:
        want = Counter(r.terms_of(text))
        scored = []
        for i, b, n in bags:
            m = 100 - 75 + (75 * n * total) // length
            s = sum(f * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t, f in want.items() if b[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def ranked(spark, docs, items, **options):
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], DOCS).repartition(3)
    return sorted((tuple(x) for x in r.top_documents(df, spark.createDataFrame([(*i, "x") for i in items], ITEMS), **options).collect()), key=str)


@pytest.mark.parametrize("limits", [{}, {"STEP": 1, "SHARD_BYTES": 2000, "BLOCK_BYTES": 300}])
def test_equals_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(r, name, value)
    rng = np.random.default_rng(3)
    words = ["Alpha", "beta", "GAMMA", "ñandú", "été", "x1", "42", "日本", "the", "of", "İx", "q\x7fr", "a-b", "É"] + [f"w{i}" for i in range(60)]
    odds = np.array([1 / (1 + i) for i in range(len(words))])
    text = lambda n: " ".join(rng.choice(words, n, p=odds / odds.sum()))
    docs = [(int(i), text(int(rng.integers(1, 60)))) for i in range(300)]
    docs += docs[:40] + [(None, docs[3][1]), (None, docs[4][1]), (-5, ""), (-6, None), (-7, " \t.,"), (-8, "the " * 30000 + "w50"), (5, "x" * 70000)]
    items = [(i, text(int(rng.integers(1, 30)))) for i in range(20)] + [(0, "the the w50"), (0, "the the w50"), (None, "été"), (30, None), (31, "--"), (32, "nowhere")]
    want = brute(docs, items)
    assert len(want) > 150 and ranked(spark, docs, items) == want
    assert ranked(spark, docs, items, k=3) == brute(docs, items, 3)


def test_empty_tables(spark):
    assert ranked(spark, [], [(1, "a")]) == [] == ranked(spark, [(1, "a")], []) == ranked(spark, [(1, None)], [(1, "a")])
    assert ranked(spark, [(1, "a"), (2, "a")], [(7, "a")]) == brute([(1, "a"), (2, "a")], [(7, "a")])


def test_an_item_stops_before_the_ends_of_its_lists():
    """A rare term decides; documents that have frequent terms only are mostly never looked up."""
    rng = np.random.default_rng(1)
    n = 20000
    size = rng.integers(50, 500, n)
    has = np.zeros((n, 3), np.int64)
    has[:, 0] = rng.integers(1, 20, n)
    has[:, 1] = rng.integers(0, 3, n)
    has[rng.choice(n, 30, replace=False), 2] = 4
    owner, term = np.nonzero(has)
    shard = r.Shard(np.arange(n), size, (has > 0).sum(axis=1), term.astype(np.int32), has[owner, term], n, int(size.sum()), 3)
    weights = [r.weight(int((has[:, t] > 0).sum()), n) for t in range(3)]
    scores, ids = shard.top(list(enumerate(weights)), 10)
    m = 25 + 75 * size * n // size.sum()
    full = sum(weights[t] * (10**9 * has[:, t] // (1000 * has[:, t] + 8 * m)) for t in range(3))
    best = np.lexsort((np.arange(n), -full))[:10]
    assert ids.tolist() == best.tolist() and scores.tolist() == full[best].tolist()
    assert shard.reads < n // 4
