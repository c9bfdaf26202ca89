import itertools
import math
import re
import zlib
from itertools import pairwise

import numpy as np
import pytest

from stratalore.llm import language_crf as crf


def test_forward_backward_matches_enumeration(monkeypatch):
    monkeypatch.setattr(crf, "BLOCK", 3)
    rng = np.random.default_rng(2)
    k, lengths = 3, np.array([1, 7, 3, 4, 6])
    potentials, trans = rng.normal(size=(lengths.sum(), k)) * 2, rng.normal(size=(k, k))
    p, pairs = crf.forward_backward(potentials, lengths, trans, pairs=True)
    at, want, expected = 0, [], np.zeros((k, k))
    for n in lengths:
        e = potentials[at : at + n]
        at += n
        total, here, joint = 0.0, np.zeros((n, k)), np.zeros((k, k))
        for ys in itertools.product(range(k), repeat=int(n)):
            w = np.exp(sum(e[i, y] for i, y in enumerate(ys)) + sum(trans[a, b] for a, b in zip(ys, ys[1:])))
            total += w
            for i, y in enumerate(ys):
                here[i, y] += w
            for a, b in zip(ys, ys[1:]):
                joint[a, b] += w
        want.append(here / total)
        expected += joint / total
    assert np.allclose(p, np.concatenate(want))
    assert np.allclose(pairs, expected)


def test_labels_words_of_switched_text():
    english = "the cat sat on the mat and then it went to the other house with them".split()
    german = "der hund ging nicht durch den wald und dann schlief er unter dem baum ein".split()
    rng = np.random.default_rng(3)
    samples = {"en": [" ".join(rng.choice(english, 40)) for _ in range(30)], "de": [" ".join(rng.choice(german, 40)) for _ in range(30)]}
    model = crf.fit(samples)
    words = [*rng.choice(english, 12), *rng.choice(german, 9), *rng.choice(english, 12)]
    at, table = model.potentials([str(w) for w in words])
    labels = model.marginals(table[at], np.array([len(words)])).argmax(axis=1)
    assert [model.languages[y] for y in labels] == ["en"] * 12 + ["de"] * 9 + ["en"] * 12
    assert model.transitions[0, 0] > model.transitions[0, 1]
    assert model.predict([None, "", "123 ²½ _ !", " ".join(words)])[:3] == [("und", 0.0)] * 3
    assert model.predict([" ".join(words)])[0][0] == "en"
    assert crf.fit({}).predict(["text"]) == [("und", 0.0)]


def test_held_out_accuracy_and_edge_cases(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = crf.train(docs)
    got = {r.doc_id: r for r in crf.identify(docs, model).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert set(got) == set(truth)
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 for d, r in got.items())
    assert np.mean([got[d].lang_pred == y for d, y in truth.items() if got[d].held_out]) > 0.98
    odd = spark.createDataFrame([(1, None, "en"), (2, "42", None), (2, "42", None), (None, "the and", "x"), (3, "the of and " * 200_000, "en")], "doc_id long, text string, lang_pred string")
    rows = sorted((r.doc_id or 0, r.lang_pred) for r in crf.identify(odd, model).collect())
    assert rows == [(0, "en"), (1, "und"), (2, "und"), (2, "und"), (3, "en")]
    assert crf.identify(docs.limit(0)).count() == 0


def test_words_count_to_their_last_letter(monkeypatch):
    stem = "q" * 40
    samples = {"en": [f"{stem}ing {stem}ought"] * 20, "de": [f"{stem}keit {stem}ung"] * 20}
    model = crf.fit(samples)
    monkeypatch.setattr(model, "lexicon", frozenset())
    words = [stem + x for x in ("ing", "keit", "ought", "ung")]
    at, table = model.potentials(words)
    assert [model.languages[y] for y in table[at].argmax(axis=1)] == ["en", "de", "en", "de"]
    monkeypatch.setattr(crf, "LETTERS", 50)
    again, rows = crf.Model(model.languages, model.weights, model.transitions, frozenset()).potentials(words)
    assert np.array_equal(rows[again], table[at])


def test_a_language_of_long_texts_only_is_learned(spark, monkeypatch):
    monkeypatch.setattr(crf, "MAX_BYTES", 4000)
    rows = [(i, "the cat sat on the mat and went home " * 20, "en") for i in range(12)]
    rows += [(100 + i, " 1" * 3000 + " der hund ging nicht durch den wald " * 200, "de") for i in range(12)] + [(200 + i, "12 - 3", "de") for i in range(12)]
    model = crf.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en"]
    assert [x for x, _ in model.predict(["der hund ging nicht", "the cat sat on the mat"])] == ["de", "en"]


def test_training_takes_null_and_repeated_ids(spark, monkeypatch):
    english, german = "the cat sat on the mat and went home", "der hund ging nicht durch den wald"
    rows = [(None, english, "en"), (None, german, "xx"), (None, None, None)] * 5 + [(1, f"{english} {i}", "en") for i in range(400)]
    rows += [(i, text, lang) for i in range(2, 60) for text, lang in ((english, "en"), (german, "de"), (german, "de"), ("", "en"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    taken = []
    fit = crf.fit
    monkeypatch.setattr(crf, "fit", lambda samples: taken.append(samples) or fit(samples))
    got = crf.identify(docs).collect()
    learnable = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(2, 60))
    assert {k: len(v) for k, v in taken[0].items()} == {"de": learnable, "en": learnable + (zlib.crc32(b"1") % 5 != 0)}
    assert len(got) == len(rows) and not any(r.held_out for r in got if r.doc_id is None)
    texts = {r.lang_pred for r in got if r.doc_id is None}
    assert texts == {"en", "de", "und"}
    monkeypatch.setattr(crf, "MAX_LANGUAGES", 1)
    with pytest.raises(ValueError, match="languages"):
        crf.train(docs)


def naive_buckets(word, lexicon):
    """Feature buckets of one word, letter by letter."""

    def bucket(letters, kind):
        h = (kind + 1) * int(crf._MIX[4]) % 2**64
        for k, c in enumerate(letters):
            h = (h ^ ord(c)) * int(crf._MIX[k % 4]) % 2**64
            h ^= h >> 29
        return h % crf.BUCKETS

    marked = f"^{word}$"
    out = [bucket(word[:k], k) for k in (1, 2, 3) if len(word) >= k] + [bucket(word[-k:][::-1], 3 + k) for k in (1, 2, 3, 4) if len(word) >= k]
    out += [bucket(marked[i : i + k], 7 + k) for k in (2, 3) for i in range(len(marked) - k + 1)]
    return out + [zlib.crc32(word.encode()) % crf.BUCKETS] * (word in lexicon)


def test_predictions_against_all_labellings(spark):
    samples = {"en": ["the cat sat on the mat and went home"] * 6, "de": ["der hund ging nicht durch den wald"] * 6, "fr": ["le chat dort dans la maison"] * 6}
    model = crf.fit(samples)
    texts = ["the hund ging home", "le chat, the wald 7", "Der nicht der", "maison", "cat dort den la mat", "chat的 12", None, "...", "the the wald wald la la"]
    for text in texts:
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        if not words:
            want = ("und", 0.0)
        else:
            emission = [[sum(float(model.weights[b, y]) for b in naive_buckets(w, model.lexicon)) for y in range(3)] for w in words]
            weight = {ys: math.exp(sum(e[y] for e, y in zip(emission, ys)) + sum(model.transitions[a, b] for a, b in pairwise(ys))) for ys in itertools.product(range(3), repeat=len(words))}
            share = [sum(v * ys.count(y) for ys, v in weight.items()) / sum(weight.values()) / len(words) for y in range(3)]
            want = (model.languages[int(np.argmax(share))], max(share))
        got = model.predict([text])[0]
        assert got[0] == want[0] and got[1] == pytest.approx(want[1], abs=1e-5)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in crf.identify(rows, model).collect()} == {i: model.predict([t])[0][0] for i, t in enumerate(texts)}
