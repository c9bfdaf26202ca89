import random

import numpy as np
import xxhash

from stratalore.llm import simhash


def naive_fp(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    sh = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hs = [xxhash.xxh64(s, seed=42).intdigest() for s in sh]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def naive_components(ids, fps, t=2):
    up = list(range(len(ids)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= t:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    low = {}
    for i, d in enumerate(ids):
        r = find(i)
        low[r] = min(low.get(r, d), d)
    return [low[find(i)] for i in range(len(ids))]


def test_fingerprint_matches_naive_and_ignores_chunking():
    rng = random.Random(1)
    texts = [None, "", " \t", "One", "one two", "É é ß\x0bx", *(" ".join(rng.choice("ab cd éf GH ij K".split()) for _ in range(rng.randint(1, 400))) for _ in range(40))]
    for t in texts:
        assert simhash.fingerprint(t.encode() if t is not None else None) == naive_fp(t)
    words = [w for run in simhash.word_runs(texts[-1].encode(), 7) for w in run]
    assert words == texts[-1].encode().split()


def test_every_pair_within_two_bits_meets_at_a_home():
    rng = np.random.default_rng(2)
    a = rng.integers(-(2**63), 2**63 - 1, 3000)
    flips = np.array([sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 3), replace=False)) for _ in a], np.uint64)
    b = (a.view(np.uint64) ^ flips).view(np.int64)
    home = simhash.homes_of(a)
    row, name, _ = simhash.anchors_of(b, 2)
    assert set(zip(range(len(a)), home.tolist())) <= set(zip(row.tolist(), name.tolist()))
    assert len(row) / len(a) < 70


def test_components_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    ids, fps = [r.doc_id for r in rows], [naive_fp(r.text) for r in rows]
    want = dict(zip(ids, naive_components(ids, fps)))
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {d: (f, want[d]) for d, f in zip(ids, fps)}


def test_crowded_anchor_and_chains(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOMES", 8)
    rng = random.Random(3)
    fps = {0}
    x = 0
    for _ in range(120):  # a long chain of two-bit steps and a dense ball
        x ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
        fps.add(x)
        fps.add(1 << rng.randrange(64) | 1 << rng.randrange(64))
    fps |= {rng.getrandbits(64) for _ in range(100)}
    fps = sorted(fps)
    nodes = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    edges = simhash.links(nodes)
    assert edges.count() < 70 * len(fps)
    roots = {r.node & (2**64 - 1): r.root for r in simhash.connected_components(edges).collect()}
    want = naive_components(list(range(len(fps))), fps)
    groups = {}
    for f, w in zip(fps, want):
        groups.setdefault(w, set()).add(roots.get(f, ("alone", f)))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "a b c d", "z"), (7, "a b c d", None), (8, "w " * 200_000, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(docs).collect()))
    assert got == [(-1, 7), (1, 1), (2, 1), (2, 1), (7, 7), (8, 8)]
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 7, 8]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_each_group_keeps_one_row_whatever_its_ids(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices("ab cd ef gh ij kl mn op qr st".split(), k=60)) for _ in range(12)]
    ids = [None] * 5 + [5, 5, 5, 6, 6, 7, None]
    rows = list(zip(ids, texts, "abcdefghijkl"))
    rows += [(5, texts[0], "m"), (9, texts[5], "n"), (None, texts[6], "o"), (6, texts[8], "p"), (6, texts[8], "i"), (None, texts[1], "b"), (5, None, "q"), (None, "", "r")]
    fps = [naive_fp(t) for _, t, _ in rows]
    groups = naive_components(list(range(len(rows))), fps)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = [tuple(r) for r in simhash.drop_near_duplicates(docs).collect()]
    of = {r: g for r, g in zip(rows, groups)}
    assert sorted(of[r] for r in got) == sorted(set(groups)) and len(set(groups)) == 13
    least = {g: min(float("inf") if r[0] is None else r[0] for r, h in zip(rows, groups) if h == g) for g in groups}
    assert all((float("inf") if r[0] is None else r[0]) == least[of[r]] for r in got)
