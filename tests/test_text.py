import re
import time

import pytest
from pyspark.sql import functions as F

from stratalore.functions import text as X
from stratalore.functions import vocabulary as V
from stratalore.functions.chunking import chunk_documents, hierarchy, sections, split_text
from stratalore.functions.porter import stem
from stratalore.plans import verbs


def value(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("v")).first().v


@pytest.mark.parametrize("word,out", [("programming", "program"), ("exercising", "exercis"), ("studied", "study"), ("running", "run"), ("shopping", "shop"), ("fitness", "fitness"), ("was", "was")])
def test_light_stem(spark, word, out):
    assert V.light_stem(word) == out
    assert value(spark, word, X.light_stem) == out


@pytest.mark.parametrize("word,out", [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("rational", "ration"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("generalizations", "gener"), ("oscillators", "oscil"), ("café", "café")])
def test_porter(word, out):
    assert stem(word) == out


def test_entities_dates_technologies(spark):
    t = "John Smith from Google visited the React conference. He discussed the new API with fetchData function."
    got = value(spark, t, lambda c: X.entities(c, 10))
    assert {"Smith", "Google", "React", "fetchData"} <= set(got)
    assert len(value(spark, "Meeting on January 15, 2025 and follow-up on 2025-02-01", lambda c: X.matches(c, V.DATE_PATTERNS))) >= 2
    assert value(spark, "We deployed the Python API on Docker with PostgreSQL database", X.technologies) == ["Python", "PostgreSQL", "Docker", "API"]
    m = value(spark, "Dr. Jane Doe met Bob Ray of Acme Widgets Inc. and deployed, Deployed it at 3:30 PM for $5 million last week, my_var 10x", X.structured_metadata)
    assert m.persons[:2] == ["Jane Doe", "Bob Ray"] and m.organizations == ["Acme Widgets Inc."] and m.activities == ["deployed"]
    assert m.times == ["3:30 PM", "30 PM"] and m.temporal_refs == ["last week"] and "$5 million" in m.quantities and "my_var" in m.technologies


@pytest.mark.parametrize("text", ["Go and Google, GoGo.", "C++ C#x C++a xC#é", "Node.js Nodexjs", "éGit GitHub Git_ Git", "Rust's REST APIs; gRPC", "", None])
def test_technologies_are_whole_words(spark, text):
    whole = [k for k in V.TECHNOLOGIES if re.search(rf"\b{re.escape(k)}\b", text or "")]
    assert value(spark, text, lambda c: F.array_intersect(X.technologies(c, 100), F.array(*map(F.lit, V.TECHNOLOGIES)))) == (None if text is None else whole)


def test_persons_of_a_long_text_take_one_search(spark):
    """A text with very many names takes time in proportion to its length."""
    letters = "abcdefghijklmnopqrst"
    names = [f"N{a}{b}{c} F{d}{a}{b}" for a in letters for b in letters for c in letters for d in letters[:3]]
    text = "x " * 3 + "met Dr. Jane Doe, " + ", ".join(names)
    start = time.monotonic()
    assert value(spark, text, lambda c: X.persons(c, 10**6)) == ["Jane Doe", *names]
    assert time.monotonic() - start < 20


def test_structured_metadata_query_leaves_nothing_out(spark, tmp_path):
    """Nine lists of a text, each with more than five values."""
    from stratalore.plans.queries import structured_metadata

    many = {
        "dates": [f"2025-01-{i}" for i in range(10, 18)],
        "times": [f"{i} pm" for i in range(1, 9)],
        "temporal_refs": ["last week", "next week", "last month", "next month", "last year", "next year", "today"],
        "quantities": [f"{i} users" for i in range(20, 28)],
        "technologies": ["Python", "Java", "Go", "Rust", "Ruby", "PHP", "my_var"],
        "activities": ["deployed", "built", "created", "tested", "fixed", "merged", "testing"],
        "persons": [f"Jane Do{c}" for c in "abcdefgh"],
        "organizations": [f"Acme{c} LLC" for c in "abcdefgh"],
    }
    text = "; ".join(v for values in many.values() for v in values)
    spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [r.asDict() for r in structured_metadata(spark, str(tmp_path)).orderBy("doc_id").collect()]
    assert got == [{"doc_id": 1, **{k: "|".join(v) for k, v in many.items()}, "locations": ""}, {"doc_id": 2, **dict.fromkeys(many, ""), "locations": ""}]


def test_every_word_with_a_topic_is_found_by_its_beginning(spark):
    """The search for likely words leaves out none that has a topic, whatever stands beside it."""
    exact, stems = V.keyword_topics(), V.stem_topics()
    words = sorted({w + put for w in [*exact, *stems] for put in ("", "s", "es", "ing", "ed", "iness", "ative", "x", "é")})
    text = "".join(w + sep for w, sep in zip(words, " .,;:!?()[]{}\"'/\\\n\u00a0\u2028" * len(words), strict=False)) + "xgame -team \U0001d400code code\U0001d400"
    each = [exact.get(w) or stems.get(V.light_stem(w)) for w in words]
    got = value(spark, text, X.counted_topics)
    assert {c.topic: c.n for c in got} == {t: each.count(t) for t in each if t}


@pytest.mark.parametrize("text", ["The Bob. the BOB Bobby? É ÉA Éa -Ab", "A  Hi THERE Bob\u0085Ray \"Ray", "x", "", None])
def test_capitalised_words_of_a_sentence(spark, text):
    """Entities are the words after a sentence's first that begin with a capital and are not all capitals."""
    cleaned = [re.sub(r"[\W_]", "", w) for s in re.split(r"(?<=[.!?])(?=[ \t\n])", text or "") for w in s.split()[1:] if len(w.encode()) > 2]
    names = {w for w in cleaned if w[:1].isupper() and not w.isupper()}
    assert set(value(spark, text, lambda c: X.entities(c, 100)) or []) - {"THERE", "BOB"} == names


def test_hashed_counts_of_every_bucket(spark):
    text = "a b c a the The THE " + " ".join(f"w{i}" for i in range(300))
    for size in (1, 7, 64):
        e = verbs.HashingEmbedder(size)
        assert value(spark, text, e.column) == e.embed(text) and value(spark, "", e.column) == [0.0] * size and value(spark, None, e.column) is None


def test_filters(spark):
    assert value(spark, "user: hello\nassistant: hi there", X.content_type) == "conversation"
    assert value(spark, "def main():\n  import os", lambda c: X.content_type(c, F.lit(None).cast("string"), F.lit("script.py"))) == "code"
    assert value(spark, "plain", lambda c: X.content_type(c, F.lit("readwise"))) == "highlight"
    assert value(spark, "api reference", lambda c: X.content_type(c, None, F.lit("README.md"))) == "documentation"
    assert value(spark, "The project deadline is next sprint", X.domain) == "work"
    assert value(spark, "nothing here", X.domain) == "personal"


def test_sentences_passages_and_small_functions(spark):
    assert value(spark, "A b. C d! E? f.g ", X.sentences) == ["A b.", "C d!", "E?", "f.g"]
    assert value(spark, None, X.sentences) == []
    assert value(spark, "x" * 501, X.truncate_text) == "x" * 500 + "..."
    text = "word " * 100 + "needle here " + "tail " * 100
    p = value(spark, text, lambda c: X.passage(c, "absent Needle"))
    assert p.startswith("...word") and p.endswith("tail...") and "needle here" in p
    assert value(spark, "short", lambda c: X.passage(c, "zzz")) == "short"
    assert value(spark, "My: Title/x-1", X.safe_title) == "My_ Title_x-1"
    assert value(spark, "../a\\b.txt", X.sanitize_filename) == "ab.txt"
    assert value(spark, "x/Y.RS", X.file_kind) == "code" and value(spark, "a.bin", X.file_kind) == "unknown"
    docs = spark.createDataFrame([(1, "One two three four five. Important key finding shows it all here. Last of the sentences in text. Tiny."), (2, "Hello world")], "doc_id long, text string")
    got = {(r.doc_id, r.rank): r.sentence for r in X.key_sentences(docs, 2).collect()}
    assert got[1, 1].startswith("Important") and (1, 2) in got and got[2, 1] == "Hello world"


def test_topics(spark):
    docs = spark.createDataFrame([(1, "I went to the gym for a workout and exercise"), (2, "Python function with recursion, programming!"), (3, "lorem ipsum"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in X.classify_topics(docs).collect()}
    assert got[1].primary_topic == "health" and got[2].primary_topic == "programming"
    assert got[3].topics == ["general"] and got[4].topics == ["general"] and got[1].confidence == 0.7


def test_topics_and_sentences_are_of_the_row(spark):
    """Rows that share an id, or have none, keep their own results; nothing is shuffled."""
    docs = spark.createDataFrame([(None, "doctor hospital nurse"), (None, "Python function"), (7, "doctor hospital nurse"), (7, "A plain sentence of some length here.")], "id long, text string")
    assert sorted((str(r.id), r.primary_topic) for r in X.classify_topics(docs, "id").collect()) == [("7", "general"), ("7", "health"), ("None", "health"), ("None", "programming")]
    assert sorted((str(r.id), r.rank, r.sentence) for r in X.key_sentences(docs, 3, "id").collect()) == [("7", 1, "A plain sentence of some length here."), ("7", 1, "doctor hospital nurse"), ("None", 1, "Python function"), ("None", 1, "doctor hospital nurse")]
    for plan in (X.classify_topics(docs, "id"), X.key_sentences(docs, 3, "id"), verbs.enrich(docs)):
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_splitter_and_sections():
    assert split_text("Hello, world!", 512) == ["Hello, world!"]
    t = "aa bb cc. dd ee\n\nff " + "g" * 40
    for size in (5, 12, 30):
        parts = split_text(t, size)
        assert "".join(re.sub(r"[\s.]", "", p) for p in parts) == re.sub(r"[\s.]", "", t)
        assert all(len(p) <= size or " " not in p for p in parts)
    md = "# Section 1\n\nParagraph one.\n\n\n\n# Section 2\n\nAnother."
    assert [s for _, s in sections(md)] == ["# Section 1\n\nParagraph one.", "# Section 2\n\nAnother."]
    levels = [c["level"] for c in hierarchy(md, 512)]
    assert set(levels) == {0, 1} and levels[0] == 0
    assert sections("no cut  ") == [(0, "no cut  ")]


def test_chunks(spark):
    long = ("Sentence number one is here. " * 60 + "\n") * 3
    docs = spark.createDataFrame([(1, "short text"), (2, long), (3, None), (4, "é" * 1200)], "doc_id long, text string")
    rows = chunk_documents(docs).collect()
    assert {r.doc_id for r in rows} == {1, 2, 4}
    assert [(r.level, r.char_start, r.char_end) for r in rows if r.doc_id == 4] == [(1, 0, 2400)]
    parts = [r for r in rows if r.doc_id == 2 and r.level == 1]
    assert len(parts) > 5 and all(len(r.text.encode()) <= 512 for r in parts)
    raw = long.encode()
    assert all(raw[r.exact_start : r.exact_start + len(r.text.encode())].decode() == r.text for r in parts)


def test_chunks_leave_a_worker_in_bounded_batches():
    import pyarrow as pa

    from stratalore.functions import chunking as CH

    texts = ["word " * 2000, "", "short", "one. two. " * 900] * 5
    batch = pa.RecordBatch.from_arrays([pa.array(range(20), pa.int64()), pa.array(texts), pa.array([len(t) > 3000 for t in texts]), pa.array([1000] * 20, pa.int32())], ["doc_id", "text", "cut", "size"])
    whole, cut = list(CH.chunk_batches(batch, 1 << 30)), list(CH.chunk_batches(batch, 4000))
    assert len(whole) == 1 and len(cut) > 9 and pa.Table.from_batches(cut).combine_chunks().equals(pa.Table.from_batches(whole).combine_chunks())
    assert max(sum(len(t) for t, v in zip(b.column("text").to_pylist(), b.column("level").to_pylist()) if v == 0) for b in cut) <= 10_000
