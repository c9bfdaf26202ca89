import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from stratalore.llm import token_files as tf
from stratalore.llm.bpe import RankMerger
from stratalore.llm.token_counts import count_tokens, counts_of
from stratalore.llm.wavelet import Plane, Shard, WaveletMatrix

FILE = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "aaaaaaaaaaaa aaaa aaa", "Hello<|endoftext|>World's", "İstanbul ΣΑΣ σας", "éa  ́x", "\x1c\x1dx\x85y z", "!" * 900, "a" * 5000, "1234 56", "don't DON'T we'll'", "日本語テスト 한국어 😀😀🏽", "x<|startoftext|><|endoftext|>y", "ﬁ ǅ ß ẞ", "�​\xad", "'s 's's 'll''ve", "word's. (word) word... word-word", "É,É. Á\x00b"]


def library(texts):
    return [e.ids for e in Tokenizer.from_file(FILE).encode_batch(texts, add_special_tokens=False)]


def test_counts_and_ids_match_the_library(sf):
    import pyarrow.parquet as pq

    texts = ODD + pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist()
    want = library(texts)
    with open(FILE, encoding="utf-8") as f:
        spec = f.read()
    assert counts_of([t.encode() for t in texts], RankMerger(spec), {}) == [len(w) for w in want]
    encoder = tf.Encoder(spec)
    assert encoder.plain is not encoder.library and encoder.latin is not encoder.library
    latin = [chr(c) for c in range(0xAA, 0x250) if tf._SPLIT.fullmatch(chr(c)) and chr(c).isalpha() and chr(c).lower() == chr(c)]
    assert len(latin) > 150 and encoder._joined(latin, encoder.latin) == encoder._one_by_one(latin)
    for end in (None, 1):
        got = encoder.encode(pa.array([*texts, None]), end)
        assert [np.frombuffer(g.as_py(), "<u2").tolist() for g in got] == [w + [end] * (end is not None) for w in [*want, []]]


@pytest.mark.parametrize("long", [4, 100])
def test_pieces_of_long_texts_and_a_small_memo(sf, monkeypatch, long):
    import pyarrow.parquet as pq

    monkeypatch.setattr(tf, "LONG", long)
    monkeypatch.setattr(tf, "MEMO_WORDS", 50)
    monkeypatch.setattr(tf, "MEMO_PARTS", 5)
    texts = ODD + pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist()[:20]
    with open(FILE, encoding="utf-8") as f:
        encoder = tf.Encoder(f.read())
    assert [np.frombuffer(encoder.encode(pa.array([t]), None)[0].as_py(), "<u2").tolist() for t in texts] == library(texts)


def test_a_tokenizer_that_keeps_white_space_is_refused():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f, pytest.raises(ValueError):
        tf.Encoder(f.read())


def test_plane_and_matrix_match_brute_force():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 512, 513, 5000):
        bits = rng.random(n) < 0.3
        plane = Plane(np.packbits(bits), n)
        assert all(plane.rank1(i) == bits[:i].sum() for i in range(0, n + 1, max(1, n // 97)))
        for bit in (0, 1):
            at = np.flatnonzero(bits == bool(bit))
            assert all(plane.select(bit, k) == at[k] for k in range(0, len(at), max(1, len(at) // 97)))
        ids = rng.integers(0, 49408, n) // rng.integers(1, 49408, n)
        shard = Shard.from_bytes(Shard.build([None, 3, 9], [n // 2, 0, n - n // 2], ids, 16).to_bytes())
        m: WaveletMatrix = shard.matrix
        assert m.decode().tolist() == ids.tolist() and shard.ids() == [None, 3, 9]
        assert all(m.access(i) == ids[i] for i in range(0, n, max(1, n // 53)))
        for t in (0, 1, 2, 77, 49407, 70000):
            at = np.flatnonzero(ids == t)
            assert m.count(t) == len(at) and m.count(t, n // 3, n // 2) == ((at >= n // 3) & (at < n // 2)).sum()
            assert [m.select(t, k) for k in range(min(5, len(at)))] == at[:5].tolist()


def test_files_round_trip(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    want, start = {}, 0
    for (d, _), ids in zip(rows, library([t for _, t in rows])):
        a = np.array([*ids, 1], "<u4")
        want[d] = (start, len(a), zlib.crc32(a.tobytes()))
        start += len(a)
    for tokens in (tf.SHARD_TOKENS, 5000):
        monkeypatch.setattr(tf, "SHARD_TOKENS", tokens)
        assert {r.doc_id: tuple(r)[1:] for r in tf.token_files(docs, FILE).collect()} == want


def test_edge_cases(spark):
    docs = spark.createDataFrame([(5, None, 1), (5, "b a", 2), (5, "b a", 2), (None, "x", 3), (-9, "", 4)], "doc_id long, text string, ids int")
    got = sorted(tf.token_files(docs, FILE).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(None, 0, 2), (-9, 2, 1), (5, 3, 1), (5, 4, 3), (5, 7, 3)]
    assert tf.token_files(docs.limit(0), FILE).count() == 0
    counts = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(docs, FILE, limit=1).collect())
    assert counts == [(-9, 0, 0, False), (0, 1, 1, False), (5, 0, 0, False), (5, 3, 2, True), (5, 3, 2, True)]
    assert count_tokens(docs.limit(0), FILE).count() == 0
