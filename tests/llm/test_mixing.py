import random
import re

import pytest

from stratalore.llm import mixing

WORDS = re.compile("[^\x20\x09-\x0d]+")


def naive_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > most * sizes[s]}
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def check(docs, got):
    sizes, of = {}, {}
    for d, text, source in docs:
        n = len(WORDS.findall(text or ""))
        sizes[source] = sizes.get(source, 0) + n
        of[d] = (n, source)
    want = naive_targets(sizes)
    taken, longest = {}, {}
    for r in got:
        n, source = of[r.doc_id]
        assert r.size == n and r.source_size == sizes[source]
        assert r.target == pytest.approx(want[source], rel=1e-9)
        assert n == 0 or r.taken % n == 0
        assert r.taken <= 2 * n
        taken[source] = taken.get(source, 0) + r.taken
        longest[source] = max(longest.get(source, 0), n)
    assert len(got) == len(docs)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s] / 2 + 1e-6


def test_synthetic_sources_and_edge_cases(spark):
    rng = random.Random(4)
    docs = [(i, " ".join("w" * rng.randint(1, 4) for _ in range(int(rng.paretovariate(0.9)))), rng.choice(["a", "a", "a", "a", "b", "Z", "é", "", None])) for i in range(3000)]
    docs += [(9000, None, "a"), (9001, "", "b"), (9002, "w " * 5000, "tiny"), (9003, None, "none")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, source string, size int")
    first = mixing.mix(df).collect()
    check(docs, first)
    assert sorted(map(tuple, first)) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()))
    sample = mixing.mixture(df)
    assert sample.columns == df.columns
    assert sample.count() == sum(r.copies for r in first)
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix(df.where("text is null")).where("taken > 0").count() == 0


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check([(r.doc_id, r.text, r.source) for r in docs.collect()], mixing.mix(docs).collect())


def test_heavier_documents_come_first_more_often(spark):
    docs = spark.createDataFrame([(i, "word " * 10 + ("#*$%" * 2 if i % 2 else ""), "a" if i < 4000 else "b") for i in range(8000)], "doc_id long, text string, source string")
    got = mixing.mix(docs, weights=(1, 9), share=1.2).where("target < source_size").collect()
    odd, even = (sum(r.taken for r in got if r.doc_id % 2 == k) for k in (1, 0))
    assert even > 1.5 * odd


def test_repeated_rows_meet_their_target(spark):
    rows = [(5, "one two three four", "a", i) for i in range(1000)] + [(i, "x " * 40, "b", i) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").repartition(3)
    for span in (7, mixing.SPAN):
        got = mixing.mix(docs, weights=(2, 30), span=span)
        goal = {r.source_size: r.target for r in got.collect()}
        taken = sum(r.taken for r in got.collect() if r.doc_id == 5 and r.size == 4)
        assert 4000 < goal[4000] < 8000 and abs(taken - goal[4000]) <= 2
    assert mixing.mixture(docs, weights=(2, 30), span=7).where("source = 'a'").count() * 4 == taken


def test_a_crowded_part_is_cut_until_it_is_small(spark, monkeypatch):
    # Weights of 0.1 send two fifths of the keys to the last of the first parts.
    docs = [(i, "## " * 3 + "w " * (i % 5), "ab"[i % 7 == 0]) for i in range(6000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)
    most, last = [], mixing._last

    def spy(rows, ends, span):
        most.append(max(r.n for r in ends.collect()))
        return last(rows, ends, span)

    monkeypatch.setattr(mixing, "_last", spy)
    got = mixing.mix(df, weights=(1, 9), share=1.1, edge=20, buckets=16).collect()
    plain = mixing.mix(df, weights=(1, 9), share=1.1).collect()
    assert most[0] <= 20 < 1000 < most[1]
    assert sorted(map(tuple, got)) == sorted(map(tuple, plain))
    for size in {r.source_size for r in got}:
        of = [r for r in got if r.source_size == size]
        assert abs(sum(r.taken for r in of) - of[0].target) <= 4
