import random
import re

from stratalore.llm import line_quality as lq

WORD = re.compile("[^\x20\x09-\x0d]+")


def naive(text):
    text = text or ""
    words = WORD.findall(text)
    seen, n_dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            n_dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    hit = {k for i, w in enumerate(windows) if count[w] > 1 for k in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), n_dup, len(hit), failed


def rows(df):
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return [(r.doc_id, *(r[c] for c in cols)) for r in lq.quality_rules(df).collect()]


def test_base_matches_brute_force(spark, sf):
    rng = random.Random(6)
    texts = [None, "", " \n\t", "a", "a " * 9, "a\x0bb\x0cc\rd", "x y\nx y\n\n \n \nx y", "é😀 ñ" * 12, "| | |", "q " * 30000]
    texts += ["".join(rng.choice(["ab", "c", " ", "\n", "é", "|", "  "]) for _ in range(rng.randint(0, 300))) for _ in range(60)]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 80))) for _ in range(60)]
    for _ in range(40):
        part = " ".join(str(rng.randint(0, 10**6)) for _ in range(rng.randint(5, 15)))
        texts.append(" ".join([part, *(str(rng.randint(0, 10**6)) for _ in range(rng.randint(0, 40))), part, "z", part]))
    docs = [*enumerate(texts), (1, "a"), (None, "b c")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_words int")
    key = lambda t: (t[0] is None, t)
    assert sorted(rows(df), key=key) == sorted([(d, *naive(t)) for d, t in docs], key=key)
    assert lq.quality_rules(df.limit(0)).count() == 0
    table = spark.read.parquet(f"{sf}/documents.parquet")
    assert sorted(rows(table)) == sorted((r.doc_id, *naive(r.text)) for r in table.collect())


def test_lines_and_verdicts(spark):
    good = "This is a plain sentence with quite a few words in it, nothing else at all.\n" * 1 + "Another one follows here and it is just as plain as the first was."
    cases = {
        0: (good, True, 0),
        1: (good + "\nhome | about | contact | help\nAll rights reserved.", True, 10),
        2: ("the*** cat%%% sat### on&&& a$$$ mat*** " * 6 + "ok", False, None),
        3: ("\n".join(f"one{k} | two{k} | three{k} | four{k}" for k in range(20)), False, None),
        4: ("\n".join(f"GO{k}!! NOW{k}!! AND{k}!! BUY{k}!! IT{k}!!" for k in range(20)), False, None),
    }
    extra = "\nHome Products About\nread on for the rest ...\n- new item\nTous droits réservés par nous.\n- this one is a whole sentence with its end."
    cases[5] = (good + extra + "\n" + good.split("\n")[0], False, 33)  # the repeated line fails the base rule
    cases[7] = (good + extra, True, 17)
    cases[6] = (good + "\nOne Two. three\nPlain words here", True, 0)
    got = {r.doc_id: r for r in lq.measure(spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "doc_id long, text string")).collect()}
    for k, (_, kept, lost) in cases.items():
        assert got[k].kept == kept, k
        assert lost is None or got[k].lost_words == lost
    assert got[1].clean_text == good
    assert got[5].clean_text == good + "\n- this one is a whole sentence with its end."


def test_clean_documents_stay(spark, sf):
    sf = sf.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = lq.quality_rules(spark.read.parquet(f"{sf}/documents.parquet")).join(labels, "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in got}
    assert n.get((1, False), 0) <= 0.02 * n[1, True]
    assert n[0, False] >= 0.8 * (n[0, False] + n.get((0, True), 0)), n
