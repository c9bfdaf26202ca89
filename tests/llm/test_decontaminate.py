import hashlib
import random
import re

from stratalore.llm import decontaminate as d

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def naive(text, items, window=13):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    words = WORD.findall(low(text))
    hit, found = set(), set()
    for item, t in items:
        w = WORD.findall(low(t))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            p = w[i : i + window]
            for j in range(len(words) - len(p) + 1):
                if words[j : j + len(p)] == p:
                    hit.update(range(j, j + len(p)))
                    if item is not None:
                        found.add(str(item))
    sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(words)


def cases():
    rng = random.Random(5)
    vocab = "the of ab é X9 zz".split()
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 5, 12, 13, 14, 30])))) for i in range(24)]
    items += [(99, None), (100, "--"), (3, items[3][1]), (None, items[5][1])]
    docs = [(k, " ".join(rng.choice([*vocab, "q,q", "(Q)"]) for _ in range(rng.randint(0, 60))) + " " + (items[rng.randrange(24)][1] if rng.random() < 0.6 else "")) for k in range(60)]
    docs += [(1000, None), (1001, ""), (1001, ""), (None, "THE of"), (1002, "w " * 3000 + items[7][1].upper())]
    return docs, items


def test_matches_brute_force_in_one_or_more_blocks(spark, monkeypatch):
    docs, items = cases()
    ddf = spark.createDataFrame([(a, b, "k") for a, b in docs], "doc_id long, text string, items string")
    idf = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((a or -1, *naive(b, items)) for a, b in docs)
    for size in (d.BLOCK_BYTES, 200):
        monkeypatch.setattr(d, "BLOCK_BYTES", size)
        got = sorted((r.doc_id or -1, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in d.contamination(ddf, idf).collect())
        assert got == want
        kept = d.drop_contaminated(ddf, idf)
        assert kept.columns == ddf.columns
        assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == sorted((a or -1, b or "") for a, b in docs if not naive(b, items)[-1])
    assert d.contamination(ddf, idf.limit(0)).where("n_hit > 0 or contaminated").count() == 0
    assert d.contamination(ddf.limit(0), idf).count() == 0


def test_tables(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = {r.doc_id: naive(r.text, items.collect()) for r in docs.orderBy("doc_id").limit(60).collect()}
    got = {r.doc_id: tuple(r)[1:] for r in d.contamination(docs, items).collect()}
    assert len(got) == docs.count()
    assert {k: got[k] for k in want} == want
    assert any(v[4] for v in got.values())
