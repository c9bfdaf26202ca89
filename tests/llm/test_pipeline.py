import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from test_decontaminate import naive as contaminated
from test_mixing import check as check_mix
from test_near_copies import naive_groups
from tokenizers import Tokenizer

import corpus_pipeline as cp
from stratalore.llm import mixing
from stratalore.llm.pairwise_quality import classify


def test_stages_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    assert len(names) == 5
    outs, now = [], docs
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, now, sf).write.parquet(str(tmp_path / str(k)))
        now = spark.read.parquet(str(tmp_path / str(k)))
        outs.append(now)
    assert all(o.columns == docs.columns for o in outs[:-1])
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    accepted = ids(classify(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1"))
    assert ids(outs[0]) == accepted
    rows = {r.doc_id: r.text for r in outs[0].collect()}
    assert ids(outs[1]) == sorted({min(g) for g in naive_groups(rows)})
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    clean = {r.doc_id for r in outs[1].collect() if not contaminated(r.text, items)[4]}
    assert set(ids(outs[2])) == clean and 0 < len(clean) < outs[1].count()
    mixed = mixing.mix(outs[2]).collect()
    check_mix([(r.doc_id, r.text, r.source) for r in outs[2].collect()], mixed)
    assert ids(outs[3]) == sorted(r.doc_id for r in mixed for _ in range(r.copies))
    tk, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for d, text in sorted((r.doc_id, r.text) for r in outs[3].collect()):
        a = np.array([*tk.encode(text, add_special_tokens=False).ids, 1], "<u4")
        want.append((d, start, len(a), zlib.crc32(a.tobytes())))
        start += len(a)
    assert sorted(map(tuple, outs[4].collect())) == want
    assert sorted(map(tuple, cp.run(spark, sf).collect())) == want


WORDS = "water house light night garden time people place world year green river stone bread".split()


@pytest.fixture(scope="module")
def odd(spark, sf, tmp_path_factory):
    """A folder whose documents have every odd case and columns that operators use names of."""
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choices(WORDS, k=n)) + "."
    rows = [(i, text(rng.randint(30, 90)), rng.choice(["a", "b", None])) for i in range(60)]
    rows += [(None, text(50), "a"), (None, text(50), None), (None, None, "a"), (7, text(40), "b"), (7, text(40), "b"), (70, None, "b"), (71, "", "b"), (72, " \n", None)]
    rows += [(80 + i, rows[3][1], "b") for i in range(5)] + [rows[4]] * 4 + [(90, " ".join(rng.choices(WORDS, k=200_000)), "a")]
    folder = str(tmp_path_factory.mktemp("odd"))
    schema = "doc_id long, text string, source string, lang string, n_chars long, file string, row int, doc string, key binary, size int, score double, source_size int"
    full = [(*r, "en", 1, "f", 2, "d", b"k", 3, 0.5, i) for i, r in enumerate(rows)]
    spark.createDataFrame(full, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(60)] + [(None, 1), (7, None)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("x", rows[10][1]), ("y", None), ("z", "")], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_on_odd_rows(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    stages = dict(cp.STAGES)
    rows = docs.collect()
    order = lambda rs: sorted(rs, key=lambda r: r.source_size)  # noqa: E731  (a number for each row)
    scored = cp.quality_classifier(spark, docs, odd)
    assert scored.schema == docs.schema and set(scored.collect()) <= set(rows)
    verdict = {r.text: True for r in scored.collect()}
    assert order(scored.collect()) == order(r for r in rows if r.text in verdict)
    single = stages["SimHash near-dedup"](spark, docs, odd)
    groups = naive_groups({k: r.text for k, r in enumerate(rows)})
    kept = single.collect()
    of = {rows[k]: number for number, g in enumerate(groups) for k in g}
    assert single.schema == docs.schema and sorted(of[r] for r in kept) == list(range(len(groups)))
    number = lambda r: float("inf") if r.doc_id is None else r.doc_id
    assert all(number(r) == min(number(x) for x in rows if of[x] == of[r]) for r in kept)
    clean = cp.benchmark_decontamination(spark, docs, odd)
    items = spark.read.parquet(f"{odd}/benchmark.parquet").collect()
    assert clean.schema == docs.schema and order(clean.collect()) == order(r for r in rows if not contaminated(r.text, items)[4])
    mixed = cp.source_mixing(spark, docs, odd)
    assert mixed.schema == docs.schema and set(mixed.collect()) <= {r for r in rows if (r.text or "").split()}
    taken, sizes = {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").split())
    for r in mixed.collect():
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    assert all(taken[s] <= 2 * sizes[s] for s in taken)
    tokens = cp.token_output(spark, docs, odd).collect()
    assert sorted(map(number, tokens)) == sorted(map(number, rows)) and sorted(r.start for r in tokens)[0] == 0
    assert sum(r.n_tokens == 1 for r in tokens) == sum(not (r.text or "").split() for r in rows)
    assert cp.run(spark, odd).count() > 0


def test_stages_on_an_empty_table(spark, odd):
    none = spark.read.parquet(f"{odd}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        out = stage(spark, none, odd)
        assert out.count() == 0
        assert stage is cp.STAGES[-1][1] or out.columns == none.columns
