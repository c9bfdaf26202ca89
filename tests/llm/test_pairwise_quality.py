import itertools
import math
import re
import zlib

import numpy as np
import pytest

from stratalore.llm import pairwise_quality as pq


def test_weights_order_pairs():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5))
    good = x @ np.array([2.0, -1, 0, 0, 0.5]) + rng.normal(size=400) * 0.1 > 0.3
    model = pq.fit(x, good)
    s = model.score(x)
    assert ((s >= pq.CUT) == good).mean() > 0.97
    assert abs((s >= pq.CUT).sum() - good.sum()) <= 1  # the quantile of the share of bad rows
    diff = model.raw(x[good])[:, None] - model.raw(x[~good])[None, :]
    assert (diff > 0).mean() > 0.99
    assert (pq.fit(x, np.ones(400, bool)).score(x) >= pq.CUT).all()


def test_held_out_accuracy_and_stage(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in pq.classify(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for d, r in got.items())
    known = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert len(known) > 50
    assert np.mean([p == q for p, q in known]) > 0.97
    kept = pq.drop_low_quality(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got.values())


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "", "b"), (None, "x y", "c"), (3, "word " * 300_000, "d"), (4, "a b. " * 30, "e")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 0), (4, 1), (4, None), (None, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    out = pq.classify(docs, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == 6
    assert pq.classify(docs.limit(0), labels).count() == 0
    assert pq.classify(docs, labels.limit(0)).where("predicted = 1").count() == 6


def naive_features(text):
    """The features of a text, counted character by character."""
    data = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0d]+", data)
    n = len(words)
    count = lambda chars: sum(data.count(c.encode()) for c in chars)
    per_word = lambda k: min(3, k / max(1, n))
    letters, capitals = sum(97 <= c <= 122 for c in data), sum(65 <= c <= 90 for c in data)
    pairs = list(itertools.pairwise(words))
    types = math.log(len(set(words))) / math.log(n) if n > 1 else 1
    return [
        math.log(1 + n) / 5, float(n < 8), min(3, max(1, len(data)) / max(1, n) / 6), capitals / max(1, capitals + letters), per_word(count("#*$%&<>")), per_word(count("|")), per_word(count("!")),
        min(1, sum(48 <= c <= 57 for c in data) / max(1, len(data)) * 10), per_word(count(".?")) * 4, per_word(count("\n")) * 4, sum(a == b for a, b in pairs) / max(1, n - 1), types**2,
        len(set(pairs)) / max(1, n - 1) if n > 1 else 1, sum(c > 127 for c in data) / max(1, len(data)),
    ]


def naive_scores(texts, labels):
    """Scores of texts {id: text} from labels [(id, quality)]: plain gradient steps on all pairs."""
    known = [(naive_features(texts[i]), q == 1) for i, q in labels if i in texts and q is not None and zlib.crc32(str(i).encode()) % 5]
    width = len(known[0][0])
    mean = [sum(x[k] for x, _ in known) / len(known) for k in range(width)]
    scale = [math.sqrt(sum((x[k] - mean[k]) ** 2 for x, _ in known) / len(known)) + 1e-6 for k in range(width)]
    z = lambda x: [max(-6, min(6, (v - m) / s)) for v, m, s in zip(x, mean, scale)]
    up, down = [z(x) for x, g in known if g], [z(x) for x, g in known if not g]
    diffs = np.array([[a - b for a, b in zip(u, d)] for u in up for d in down])
    w = np.zeros(width)
    step = 1 / (np.linalg.norm(diffs, 2) ** 2 / len(diffs) / 4 + pq.RIDGE)
    move = np.zeros(width)
    for _ in range(30_000):
        move = 0.9 * move + step * 0.1 * (-(diffs * (1 / (1 + np.exp(diffs @ w)))[:, None]).mean(axis=0) + pq.RIDGE * w)
        w = w - move
    raw = lambda x: float(np.dot(z(x), w))
    ordered, k = sorted(raw(x) for x, _ in known), len(down)
    threshold = (ordered[k - 1] + ordered[min(k, len(ordered) - 1)]) / 2
    return {i: 1 / (1 + math.exp(-max(-40, min(40, raw(naive_features(t)) - threshold + math.log(0.3 / 0.7))))) for i, t in texts.items()}


def test_scores_against_plain_python(spark):
    rng = np.random.default_rng(5)
    words = "the of a in time. day? work\n house garden water Light Night".split(" ")
    texts = {i: " ".join(rng.choice(words, rng.integers(1, 60))) + (" ##|| BUY!! 99$ buy buy" * int(rng.integers(0, 6)) if i % 3 == 0 else "") for i in range(90)}
    texts |= {90: None, 91: "", 92: "éà " * 20}
    labels = [(i, int(i % 3 != 0)) for i in range(0, 80)] + [(1, 0), (90, 0), (5, None), (500, 1)]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in pq.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    want = naive_scores(texts, labels)
    assert all(got[i].score == pytest.approx(want[i], abs=1e-3) for i in texts)
    assert all(got[i].predicted == (want[i] >= 0.3) for i in texts if abs(want[i] - 0.3) > 2e-3)


def test_repeated_ids_bring_one_row_each(spark, monkeypatch):
    docs = spark.createDataFrame([(4, "a good text with words. ")] * 500 + [(7, "## !! $$")] * 500, "doc_id long, text string")
    seen = []
    fit = pq.fit
    monkeypatch.setattr(pq, "fit", lambda x, good: seen.append(len(x)) or fit(x, good))
    labels = spark.createDataFrame([(4, 1), (7, 0), (7, 0), (None, 1), (3, None)], "doc_id long, quality int")
    assert pq.classify(docs, labels).where("predicted = 1").count() == 500 and seen == [sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in (4, 7, 7))]
