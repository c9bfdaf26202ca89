"""Line-first cleaning with document rules, in native expressions only.

Lines are judged one by one: a line fails if it is navigation (cells parted by
bars, or a menu of a few capitalised words), markup noise (about one mark of
``#*$%&|<>`` for every third word), shouting (exclamation marks on most words),
boilerplate (fixed phrases), a teaser (short and ending in an ellipsis), or a
fragment (too few words, or a bullet with few, and no closing punctuation), or if
it repeats an earlier line of the text. Failing lines are removed; a document is
rejected if too large a share of its words goes with them, or if it fails the base
rules (too few words, too many words in repeated 8-word windows).

Windows are compared by chained 64-bit hashes of their words.

Defined results: a null or empty text has zero of everything and fails the base
rules; repeated rows give a row each; an empty table gives an empty table; other
columns are ignored by the operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalore.llm.expressions import SPACE, let, words

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Largest share of a document's words that removed lines may take away, in percent.
MAX_LOST_PERCENT = 50
SYMBOLS = "[#*$%&|<>]"
#: Fixed phrases of page furniture, lower case.
PHRASES = [
    "all rights reserved", "terms of (use|service)", "privacy policy", "cookie policy", "accept( all)? cookies", "enable javascript", "lorem ipsum", "sign up for our newsletter", "click here to", "skip to (main )?content",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "cookies akzeptieren", "newsletter abonnieren", "zum inhalt springen",
    "tous droits réservés", "mentions légales", "politique de confidentialité", "accepter les cookies", "aller au contenu",
    "todos los derechos reservados", "aviso legal", "política de privacidad", "aceptar (las )?cookies", "saltar al contenido",
]
BOILERPLATE = f"({'|'.join(PHRASES)})"
CLOSING = "[.!?\\u2026\"'\\u201d\\u00bb):;][\\x20\\x09-\\x0D#*$%&|<>]*\\z"
#: A line with fewer words and no closing punctuation is a fragment.
FRAGMENT_WORDS = 3
#: A bullet with fewer words and no closing punctuation is a fragment; a line with fewer that ends in an ellipsis is a teaser.
BULLET_WORDS, TEASER_WORDS = 4, 10
BULLET = f"^[{SPACE}]*[-*\u2022\u00b7\u25aa\u2023][{SPACE}]"
TEASER = f"(\\.\\.\\.|\u2026)[{SPACE}]*\\z"
#: Two to six words, all with a capital first letter, and nothing else.
MENU = f"^[{SPACE}]*\\p{{Lu}}[^{SPACE}.!?:]*([{SPACE}]+\\p{{Lu}}[^{SPACE}.!?:]*){{1,5}}[{SPACE}]*\\z"


def n_repeat_words(tokens: Column, window: int = WINDOW) -> Column:
    """Words in windows of 8 words that occur twice or more in the array."""
    if window != 8:
        raise ValueError("windows are hashed by doubling: 8 words")

    def pair(xs: Column, gap: int) -> Column:
        n = F.size(xs) - gap
        return F.zip_with(F.slice(xs, 1, n), F.slice(xs, gap + 1, n), lambda a, b: F.xxhash64(a, b))

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            marked = F.transform(s, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"]).otherwise(F.lit(-1)))
            return F.sort_array(F.filter(marked, lambda i: i >= 0))

        def total(at: Column) -> Column:
            steps = F.transform(at, lambda p, k: F.least(F.lit(8), F.coalesce(F.get(at, k + 1) - p, F.lit(8))).cast("long"))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)

        return let(let(ordered, twice), total)

    hashed = let(pair(tokens, 1), lambda two: let(pair(two, 2), lambda four: pair(four, 4)))
    none = F.lit(0).cast("long")
    found = let(hashed, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), none).otherwise(covered(w)))
    return F.when(F.size(tokens) <= window, none).otherwise(found)


def line_failures(line: Column, n: Column, bars: Column) -> dict[str, Column]:
    """Rules that a line of ``n`` words and so many bars fails, in the order in which they are reported."""
    open_end = ~line.rlike(CLOSING)
    return {
        "navigation": ((bars >= 2) & (bars * 3 >= n)) | (n.between(2, 6) & line.rlike(MENU)),
        "symbols": F.regexp_count(line, F.lit(SYMBOLS)) * 3 > n,
        "shouting": (n >= 3) & (F.regexp_count(line, F.lit("!!")) * 2 > n),
        "boilerplate": F.lower(line).rlike(BOILERPLATE),
        "teaser": (n < TEASER_WORDS) & line.rlike(TEASER),
        "punctuation": ((n < FRAGMENT_WORDS) & open_end) | ((n <= BULLET_WORDS) & line.rlike(BULLET) & open_end),
    }


def bad_line(line: Column) -> Column:
    """Whether a line fails any rule; its words and bars are counted once."""
    counts = F.struct(F.regexp_count(line, F.lit(f"[^{SPACE}]+")).alias("n"), (F.char_length(line) - F.char_length(F.replace(line, F.lit("|"), F.lit("")))).alias("bars"))

    def failed(c: Column) -> Column:
        out = F.lit(False)
        for rule in line_failures(line, c["n"], c["bars"]).values():
            out = out | rule
        return out

    return let(counts, failed)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_lost: int = MAX_LOST_PERCENT) -> DataFrame:
    """Per row: doc_id, counts, the cleaned text, words lost with removed lines, and the verdicts."""
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    long = lambda c: c.cast("long")
    has_word = lambda x: x.rlike(f"[^{SPACE}]")
    of_words = let(words(F.col("text")), lambda w: F.struct(long(F.size(w)).alias("n_words"), long(F.char_length(F.array_join(w, ""))).alias("word_chars"), n_repeat_words(w).alias("n_repeat_words")))
    of_lines = let(
        F.filter(F.split("text", "\n", -1), has_word),
        lambda ls: let(F.array_distinct(ls), lambda once: F.struct(long(F.size(ls) - F.size(once)).alias("n_dup_lines"), F.array_join(F.filter(once, lambda x: ~bad_line(x)), "\n").alias("clean_text"))),
    )
    got = base.select("doc_id", long(F.regexp_count("text", F.lit(SYMBOLS))).alias("n_symbols"), of_words.alias("w"), of_lines.alias("l"))
    flat = got.select("doc_id", "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.clean_text", long(F.regexp_count("l.clean_text", F.lit(f"[^{SPACE}]+"))).alias("clean_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    lost = F.col("n_words") - F.col("clean_words")
    return flat.withColumns({"lost_words": lost, "base_failed": failed}).withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_words") <= max_lost * F.col("n_words")))


def quality_rules(docs: DataFrame, **options) -> DataFrame:
    return measure(docs, **options).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words")
