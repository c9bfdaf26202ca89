"""Personal data: patterns propose spans, checksums confirm them, context words adjust scores.

Native expressions only. The base kinds (email, ip, card, phone) keep every match
that passes its check. Further kinds (IBAN with mod-97, social security numbers,
national phone numbers, access keys, private keys, assigned passwords) need a score
of ``THRESHOLD`` or more, which words before the match raise or lower, and must not
overlap a base span. An IBAN may be followed by more words in capitals: the longest
run of groups that passes its check counts. Patterns are written
with possessive quantifiers and look-behinds, so a match is found in time linear in
the text; offsets are code points, the end exclusive.

Defined results: a null text counts as empty; repeated rows give a row each; an
empty table gives an empty table; other columns are ignored by the operator.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalore.llm.expressions import let, prefix_maxima, prefix_sums

THRESHOLD = 0.5
#: Code points before a match in which context words count.
CONTEXT = 40


@dataclass(frozen=True)
class Kind:
    """A pattern, its prefilter (text that any match has in it), its score and context words."""

    name: str
    pattern: str
    contains: str
    score: float
    raising: str
    lowering: str = "(?!)"
    base: bool = False


_EMAIL_CHARS = "[A-Za-z0-9._%+-]"
KINDS = [
    Kind("email", f"(?:(?<!{_EMAIL_CHARS})|\\G){_EMAIL_CHARS}++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++", "@", 0.9, "(mail|contact|kontakt|correo|courriel)", base=True),
    Kind("ip", "(?<![0-9])[0-9]++(?:\\.[0-9]++){3}", ".", 0.7, "(ip|address|host|server)", "(version|release|section)", base=True),
    Kind("card", "[0-9](?:[\\x20-]?[0-9])++", "", 0.8, "(card|visa|credit|karte|tarjeta|carte)", "(order|serial|isbn)", base=True),
    Kind("phone", "\\+[0-9][\\x20().0-9-]+[0-9]", "+", 0.8, "(tel|phone|call|fax|mobil)", base=True),
    Kind("iban", "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])", "", 0.7, "(iban|account|bank|konto|cuenta|compte)"),
    Kind("ssn", "(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "-", 0.5, "(ssn|social)", "(part|order|isbn|serial|ref)"),
    Kind("us_phone", "(?<![0-9+.-])(?:\\([2-9][0-9]{2}\\)\\x20?|[2-9][0-9]{2}[.\\x20-])[2-9][0-9]{2}[.\\x20-][0-9]{4}(?![0-9-])", "", 0.3, "(tel|phone|call|fax|mobile|cell)"),
    Kind("access_key", "(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[opsur]_[A-Za-z0-9]{36,255}|xox[abprs]-[A-Za-z0-9-]{10,250}|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{16,250})(?![A-Za-z0-9])", "", 0.8, "(key|token|secret|access)", "(example|sample|dummy)"),
    Kind("private_key", "-----BEGIN\\x20(?:[A-Z]{2,10}\\x20)?PRIVATE\\x20KEY-----", "PRIVATE", 0.9, "(key|secret)"),
    Kind("password", "(?<![A-Za-z0-9])(?i:password|passwd|passwort|secret|api[_-]?key|access[_-]?token)\\x20?[=:]\\x20?(?=[^\\x20\\x09-\\x0D]{0,63}[0-9])[A-Za-z0-9_+/.~@!$-]{8,200}", "", 0.6, "(login|user|account)", "(example|sample|dummy)"),
]
#: Kinds that a text without digits can have.
_WITHOUT_DIGITS = {"email", "private_key", "access_key"}
_SPAN = "array<struct<start:bigint,kind_no:int,end:bigint,kind:string,score:double>>"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def worth(c: Column, i: Column) -> Column:
        double = c.cast("int") * 2
        return F.when(i % 2 == 1, F.when(double > 9, double - 9).otherwise(double)).otherwise(c.cast("int"))

    values = F.transform(F.split(F.reverse(digits), ""), worth)
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces passes its mod-97 check."""
    turned = F.split(F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4)), "")
    value = lambda c: F.when(c <= "9", c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(turned, F.lit(0), lambda a, c: F.when(c <= "9", a * 10 + value(c)).otherwise(a * 100 + value(c)) % 97) == 1


def _confirmed(kind: str, match: Column) -> Column:
    n = F.char_length(_digits(match))
    if kind == "ip":
        return F.forall(F.split(match, "\\."), lambda p: let(F.ltrim(p, F.lit("0")), lambda q: (F.char_length(q) <= 3) & (F.coalesce(q.try_cast("int"), F.lit(0)) <= 255)))
    if kind == "card":
        return n.between(14, 19) & luhn(_digits(match))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _iban(match: Column) -> Column:
    """The longest run of groups from the first on that is an IBAN; null if none is."""
    valid = lambda m: let(F.replace(m, F.lit(" "), F.lit("")), lambda x: F.char_length(x).between(15, 34) & mod97(x))
    runs = lambda g: F.transform(F.sequence(F.lit(1), F.size(g)), lambda k: F.array_join(F.slice(g, F.lit(1), k), " "))
    return let(let(F.split(match, " "), lambda g: F.filter(runs(g), valid)), lambda ok: F.get(ok, F.size(ok) - 1))


def _spans(text: Column, number: int, kind: Kind) -> Column:
    """Confirmed spans of one kind with their scores."""

    def located(parts: Column) -> Column:
        matches, gaps = parts["m"], parts["g"]
        steps = F.transform(matches, lambda m, i: (F.char_length(F.get(gaps, i)) + F.char_length(m)).cast("long"))

        def build(ends: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                before = F.lower(F.right(F.get(gaps, i), F.lit(CONTEXT)))
                score = F.lit(kind.score) + F.when(before.rlike(kind.raising), 0.3).otherwise(0.0) - F.when(before.rlike(kind.lowering), 0.3).otherwise(0.0)
                start = F.get(ends, i) - F.char_length(m)
                end = start + F.char_length(_iban(m)) if kind.name == "iban" else F.get(ends, i)
                return F.struct(start.alias("start"), F.lit(number).alias("kind_no"), end.alias("end"), F.lit(kind.name).alias("kind"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"), m.alias("m"))

            good = lambda s: s["end"].isNotNull() & _confirmed(kind.name, s["m"]) & (F.lit(kind.base) | (s["score"] >= THRESHOLD))
            return F.transform(F.filter(F.transform(matches, one), good), lambda s: F.struct(s["start"], s["kind_no"], s["end"], s["kind"], s["score"]))

        return let(prefix_sums(steps), build)

    found = let(F.struct(F.regexp_extract_all(text, F.lit(kind.pattern), 0).alias("m"), F.split(text, kind.pattern, -1).alias("g")), located)
    return F.when(text.contains(kind.contains) & text.rlike(kind.pattern), found).otherwise(F.array()).cast(_SPAN)


def _apart(spans: Column) -> Column:
    """Sorted spans without the further ones that overlap a base span, by one sweep from either side."""
    base = lambda s: s["kind_no"] < sum(k.base for k in KINDS)
    far = -(1 << 62)
    # Over the spans up to each place: the last end of a base span, and from the right its first start (negated).
    ends = prefix_maxima(F.transform(spans, lambda s: F.when(base(s), s["end"]).otherwise(F.lit(far))), far)
    starts = prefix_maxima(F.transform(F.reverse(spans), lambda s: F.when(base(s), -s["start"]).otherwise(F.lit(far))), far)
    clear = lambda s, i, e, b: (F.get(e, i) <= s["start"]) & (F.get(b, F.size(b) - 1 - i) <= -s["end"])
    return let(ends, lambda e: let(starts, lambda b: F.filter(spans, lambda s, i: base(s) | clear(s, i, e, b))))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, base spans and all spans, each by start, then kind."""
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    number = {k.name: i for i, k in enumerate(KINDS)}
    only_digits = [k for k in KINDS if k.name not in _WITHOUT_DIGITS]
    with_digit = F.when(text.rlike("[0-9]"), F.struct(*[_spans(text, number[k.name], k).alias(k.name) for k in only_digits]))
    parts = base.select("doc_id", *[_spans(text, number[k.name], k).alias(k.name) for k in KINDS if k.name in _WITHOUT_DIGITS], with_digit.alias("d"))
    got = lambda k: F.col(k.name) if k.name in _WITHOUT_DIGITS else F.coalesce(F.col(f"d.{k.name}"), F.array().cast(_SPAN))
    based = parts.select("doc_id", F.sort_array(F.concat(*[got(k) for k in KINDS if k.base])).alias("base"), F.concat(*[got(k) for k in KINDS if not k.base]).alias("extra"))
    return based.select("doc_id", "base", F.when(F.size("extra") == 0, F.col("base")).otherwise(let(F.sort_array(F.concat("base", "extra")), _apart)).alias("spans"))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_report(docs: DataFrame, **options) -> DataFrame:
    """Counts, digest and spans of every row; ``n_spans`` counts all kinds, ``scores`` are those of ``spans``."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return find_pii(docs, **options).select("doc_id", *[count(k.name) for k in KINDS if k.base], F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), F.transform("spans", lambda s: F.round(s["score"], 2)).alias("scores"))
