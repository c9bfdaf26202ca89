"""The text queries and their SQL take all documents."""

import hashlib
import re

import pytest
from sql_compare import connect

from stratalore.functions import vocabulary as V
from stratalore.plans.queries import QUERIES, SQL

NAMES = ["content_type", "sentence_split", "key_sentences", "dates", "times", "temporal", "quantities", "pii_raw_counts"]
PATTERNS = {"dates": V.DATE_PATTERNS, "times": V.TIME_PATTERNS, "temporal": V.TEMPORAL_PATTERNS, "quantities": V.QUANTITY_PATTERNS}
TEXTS = [
    None,
    "",
    "plain words only",
    "Größe 3 KB, café am 2025-02-01 um 3:30 PM, ü10x nicht, „5 items“ 😀 10x. Last week – später, today! École fermée? Ja.",
    "Dear Éva, writé soon.\n　Où est 12:45 é? naïve_x camelCase é. ",
    "User: ça va 😀? Zoë wrote zoe@example.org, +1 555 123 4567, 192.168.1.100 and https://exämple.org/ü “x”.",
    "ünïcode discussed à midi . January 15, 2025é January 16, 2025 – ٣٤:٥٦ Q3 2024, $1,000 million…",
    " ".join(f"Der Satz Nummer {i} über Äpfel und Öl im Überblick{' ist important' * (i % 3)}, ÉTÉ Été{' été' * i}." for i in range(14)) + " Der Überblick endet hier, über alles gesagt und getan.",
]


def whole(patterns, text):
    return [m.group(0) for p in patterns for m in re.finditer(p, text or "")]


def has(patterns, text):
    return any(re.search(p, text) for p in patterns)


def content_type(text):
    text = text or ""
    low = text.lower()
    if has(V.EMAIL_PATTERNS, low):
        return "email"
    if has(V.LIST_PATTERNS, low) or "todo" in low or "checklist" in low:
        return "list"
    if has(V.MEETING_PATTERNS, low):
        return "meeting"
    return "code" if has(V.CODE_PATTERNS, text) else "conversation" if has(V.CONVERSATION_PATTERNS, low) else "note"


def sentences(text):
    return [x for x in map(str.strip, re.split(r"(?<=[.!?])(?=[ \t\n\r\f])", text or "")) if x]


def capital(w):
    return w[:1].isupper() and not all(c.isupper() for c in w)


def key_sentences(text):
    found = [s for s in sentences(text) if len(s.encode()) > 20]
    if not found:
        return [None if text is None else text[:500]]
    total, scored = len(found), []
    for i, s in enumerate(found):
        size = len(s.encode())
        score = max(3 - i, 0) + 2 * (total > 5 and i >= total - 2) + (2 if 50 < size < 200 else size >= 200)
        score += 2 * sum(w in s.lower() for w in V.KEY_SENTENCE_WORDS) + min(3, sum(map(capital, re.split(r"\s+", s)[1:])))
        scored.append((-(score + has([V.KEY_CAMEL], s) + has([V.KEY_SNAKE], s)), i, s))
    best = sorted(scored)
    if total > 10:
        once = [x for k, x in enumerate(best) if x[2] not in [y[2] for y in best[:k]]]
        part = lambda i: 0 if i < total // 3 else 1 if i < 2 * (total // 3) else 2
        first = [next((x for x in once if part(x[1]) == p), None) for p in range(3)]
        best = [x for x in first if x] + [x for x in once if x not in first]
    return [s for _, _, s in best[:3]]


def brute(name, text):
    """What a query says of one text, without its id."""
    if name == "content_type":
        return [(content_type(text),)]
    if name == "sentence_split":
        s = sentences(text)
        return [(len(s), hashlib.sha256("|".join(s).encode()).hexdigest())]
    if name == "key_sentences":
        return list(enumerate(key_sentences(text), 1))
    if name == "pii_raw_counts":
        return [(k, n) for k, p in V.PII_PATTERNS.items() if (n := len(whole([p], text)))]
    return [("|".join(list(dict.fromkeys(whole(PATTERNS[name], text)))[:5]),)]


@pytest.fixture(scope="module")
def accents(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("accents"))
    spark.createDataFrame([(i, t, "de", "web", len(t or "")) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("name", NAMES)
def test_every_text_matches_brute_force(spark, accents, name):
    key = lambda r: tuple(map(str, r))
    want = sorted(((i, *r) for i, t in enumerate(TEXTS) for r in brute(name, t)), key=key)
    assert sorted(map(tuple, QUERIES[name](spark, accents).collect()), key=key) == want


@pytest.mark.parametrize("name", NAMES)
def test_sql_of_every_text_matches_brute_force(accents, name):
    got = connect(accents, ["documents"]).execute(SQL[name]).fetchall()
    key = lambda r: tuple(map(str, r))
    odd = 6  # its digits and boundaries beyond ASCII are not in reach of DuckDB's expressions
    want = sorted(((i, *r) for i, t in enumerate(TEXTS) if i != odd for r in brute(name, t)), key=key)
    assert sorted((r for r in got if r[0] != odd), key=key) == want
