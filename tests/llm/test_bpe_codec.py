from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stratalore.llm import bpe_codec as bc
from stratalore.llm.transducer import Transducer, compiled

FILE = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "aaaaaaaaaaaa aaaa aaa", "Hello<|endoftext|>World's", "x<|ENDOFTEXT|> <|EndOfText|>", "İstanbul ΣΑΣ σας İ. İ", "éa  ́x é. é́!", "\x1c\x1dx\x85y z", "!" * 900, "a" * 5000, "1234 56", "don't DON'T we'll'", "日本語テスト 한국어 😀😀🏽", "x<|startoftext|><|endoftext|>y",
       "ﬁ ǅ ß ẞ ŉ ſ Ŋ. ×. ÷! ñ÷", "�​\xad", "'s 's's 'll''ve", "word's. (word) word... word-word", "É,É. Á\x00b ÀÇÑ!? Œuvre; Žluťoučký,", "Ã\x83 Å Ä."]


def library(texts):
    t = Tokenizer.from_file(FILE)
    out = []
    for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False):
        ids = np.array(e.ids, "<u4")
        out.append((len(ids), sha256(ids.tobytes()).hexdigest(), sha256(t.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def spec():
    with open(FILE, encoding="utf-8") as f:
        return f.read()


def lexicon(spec, texts):
    """A lexicon of every second part of some texts."""
    words, _, _ = bc.distinct_words(pa.array(texts))
    parts = sorted(p for p in bc.split_words(words)[0].to_pylist() if 0 < len(p) <= bc.LONGEST)[::2]
    ids, lengths = bc.Codec(spec, Transducer(compiled([]))).merged(parts)
    return compiled(zip(parts, (tuple(x.tolist()) for x in np.split(ids, np.cumsum(lengths)[:-1]))))


def test_odd_texts_and_a_corpus_match_the_library(spec, sf):
    import pyarrow.parquet as pq

    texts = [*ODD, None, *pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist()]
    want = library(texts)
    for source in (compiled([]), lexicon(spec, texts)):
        assert bc.Codec(spec, Transducer(source)).round_trip(pa.array(texts)) == want


@pytest.fixture(scope="module")
def codec(spec):
    return bc.Codec(spec, Transducer(lexicon(spec, ODD)))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8", exclude_categories=["Cs"]), st.sampled_from(list("aAéÉñİ×.,'<|> \t1"))), max_size=30), min_size=1, max_size=8))
def test_any_texts_match_the_library(codec, texts):
    assert codec.round_trip(pa.array(texts)) == library(texts)


def test_long_texts_in_pieces_and_a_small_memo(spec, sf, monkeypatch):
    import pyarrow.parquet as pq

    texts = [*ODD, *pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist()[:20], "x" * 3000, " " * 3000]
    monkeypatch.setattr(bc, "LONG", 50)
    monkeypatch.setattr(bc, "MEMO", 30)
    monkeypatch.setattr(bc, "MERGE_BYTES", 40)
    monkeypatch.setattr(bc, "ENDLESS", 2000)
    codec = bc.Codec(spec, Transducer(compiled([])))
    assert [codec.round_trip(pa.array([t]))[0] for t in texts] == library(texts)


def test_transducer_is_minimal_and_exact(tmp_path):
    rng = np.random.default_rng(4)
    words = sorted({bytes(rng.choice(list(b"abc"), int(rng.integers(1, 8))).tolist()) for _ in range(400)})
    table = {w: tuple(int(x) for x in rng.integers(0, 4, int(rng.integers(0, 4)))) for w in words}
    path = tmp_path / "lexicon"
    path.write_bytes(compiled(sorted(table.items())))
    for t in (Transducer(str(path)), Transducer(path.read_bytes())):
        asked = [*words, b"", b"zz", b"abcabcabcabc", *(w + b"c" for w in words[:50]), *(w[:-1] for w in words[:50])]
        lengths = np.array([len(w) for w in asked])
        found, ids, sizes = t.look_up(np.frombuffer(b"".join(asked), np.uint8), np.cumsum(lengths) - lengths, lengths)
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        assert [tuple(p.tolist()) if f else None for f, p in zip(found, parts)] == [table.get(w) for w in asked]
    # Equal endings are one state: these words differ in their first letter and ids only.
    shared = [(bytes([c]) + b"ending", (c,)) for c in range(97, 123)]
    assert Transducer(compiled(shared)).states == 8
    with pytest.raises(ValueError):
        compiled([(b"b", ()), (b"a", ())])
    with pytest.raises(ValueError):
        Transducer(b"\0" * 64)


def test_query_on_odd_tables(spark, spec):
    rows = [(1, "b a", 1, "x"), (1, "b a", 1, "x"), (None, None, 2, "y"), (-3, "", 3, None), (4, "Ñandú, ñandú! " * 2000 + "z" * 9000, 4, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids_sha256 string").repartition(3)
    want = sorted(((r[0], *w) for r, w in zip(rows, library([r[1] for r in rows]))), key=str)
    for number in (1, 3, bc.LEXICON):
        assert sorted((tuple(r) for r in bc.round_trips(docs, FILE, number).collect()), key=str) == want
    assert bc.round_trips(docs.limit(0), FILE).count() == 0
    four = [b"!", b",", "Ñandú".encode(), "ñandú".encode()]  # 2000 times each
    assert [sorted(bc.frequent_parts(docs, n)) for n in (3, 4, 6)] == [[], four, sorted([*four, b"a", b"b"])]


def test_query_matches_the_library(spark, sf):
    from stratalore.llm.queries import op13_bpe_codec

    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, op13_bpe_codec(spark, sf).collect())) == sorted((r.doc_id, *w) for r, w in zip(rows, library([r.text for r in rows])))
