"""Text functions as native expressions: hashing, sentences, stems, topics, entities, filters.

Lengths in thresholds are UTF-8 bytes; positions and cuts are code points. Regular
expressions use Unicode classes. A null text gives null scalars and empty arrays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalore.functions import vocabulary as V
from stratalore.functions.expressions import let

UNICODE = "(?U)"


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def extension(path: Column) -> Column:
    """Lower-case extension without the dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def file_kind(path: Column) -> Column:
    ext = extension(path)
    return reduce(lambda c, kv: c.when(ext.isin(kv[1]), kv[0]), list(V.FILE_KINDS.items())[1:], F.when(ext.isin(V.FILE_KINDS["text"]), "text")).otherwise("unknown")


def is_text_kind(kind: Column) -> Column:
    return kind.isin("text", "markdown", "code", "json")


def should_chunk(text: Column, ext: Column | None = None) -> Column:
    """Whether a text is cut into chunks; ``ext`` has its dot."""
    n, e = F.octet_length(text), F.lower(ext) if ext is not None else F.lit(None).cast("string")
    return F.when(n < 2000, False).when(e.isin(V.CODE_EXTENSIONS), n > 5000).when(e.isin(V.LONG_EXTENSIONS), n > 2000).otherwise(n > 3000)


def chunk_size(ext: Column) -> Column:
    e = F.lower(ext)
    return F.when(e.isin(V.CODE_EXTENSIONS), 400).when(e.isin(V.WIDE_EXTENSIONS), 600).otherwise(512)


def chunk_overlap(ext: Column) -> Column:
    e = F.lower(ext)
    return F.when(e.isin(V.CODE_EXTENSIONS), 80).when(e.isin(V.WIDE_EXTENSIONS), 120).otherwise(100)


def trim_unicode(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    """Trimmed non-empty sentences; a boundary is . ! or ? before ASCII white space."""
    parts = F.split(text, r"(?<=[.!?])(?=[ \t\n\r\f])", -1)
    return F.coalesce(F.filter(F.transform(parts, trim_unicode), lambda s: s != ""), F.array().cast("array<string>"))


def matches(text: Column, patterns: list[str], most: int | None = None, group: int = 0) -> Column:
    """All matches of the patterns in turn, first of equal ones kept, at most ``most``."""
    found = F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(UNICODE + p), group) for p in patterns]))
    found = F.coalesce(found, F.array().cast("array<string>"))
    return F.slice(found, 1, most) if most else found


def any_match(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(UNICODE + p) for p in patterns])


def light_stem(word: Column) -> Column:
    """The light stemmer: first matching suffix rule on words over 3 bytes."""
    size = F.octet_length(word)
    cut = lambda s, put: F.concat(F.left(word, F.char_length(word) - len(s)), F.lit(put))
    chain = F.when(size <= 3, word)
    for suffix, put in V.STEM_RULES:
        chain = chain.when((size > len(suffix) + 1) & word.endswith(suffix), cut(suffix, put))
    return chain.otherwise(word)


TOPIC_SPLIT = "[\\s,.;:!?()\\[\\]{}\"'/\\\\]+"


def topic_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), UNICODE + TOPIC_SPLIT), lambda w: F.octet_length(w) >= 2)


def word_topic(word: Column) -> Column:
    """Topic of a word: that of the word itself, else that of its stem; null for most words."""
    exact, stems = V.keyword_topics(), V.stem_topics()
    named = lambda table, value: F.element_at(F.create_map(*[F.lit(x) for item in sorted(table.items()) for x in item]), value)
    # Hashed sets come first: few words are in them, so the maps and the chain of suffix rules run for few.
    # A rule keeps two letters at least. If it keeps three, they begin the stem; if two, the stem has what it puts in their place.
    put = max(len(p) for _, p in V.STEM_RULES)
    start = lambda n, longest: F.substring(word, 1, n).isin(sorted({s[:n] for s in stems if len(s) <= longest}))
    near = start(3, 1 << 10) | ((F.octet_length(word) <= 2 + max(len(s) for s, _ in V.STEM_RULES)) & start(2, 2 + put))
    return F.when(word.isin(sorted(exact)), named(exact, word)).when(near, named(stems, light_stem(word)))


def _likely_words() -> str:
    """A pattern of whole topic words that begin as a keyword or a stem does; all words with a topic match, and few others."""
    exact, stems = V.keyword_topics(), V.stem_topics()
    put, cut = max(len(p) for _, p in V.STEM_RULES), max(len(s) for s, _ in V.STEM_RULES)
    bounds = TOPIC_SPLIT[1:-2]
    begins = lambda starts: "|".join(f"{a}(?:{'|'.join(sorted(s[1:] for s in starts if s[0] == a))})" for a in sorted({s[0] for s in starts}))
    threes, twos = {w[:3] for w in [*exact, *stems]}, {s[:2] for s in stems if len(s) <= 2 + put}
    firsts = "".join(sorted({w[0] for w in threes | twos}))
    return rf"{UNICODE}(?=[{firsts}])(?<![^{bounds}])(?:(?:{begins(threes)})[^{bounds}]*|(?:{begins(twos)})[^{bounds}]{{0,{cut}}}(?![^{bounds}]))"


def counted_topics(text: Column) -> Column:
    """Array of (n, topic): keyword hits of each topic that has any, exact words first, stems else."""
    # One search of the text leaves the few words that may have a topic.
    likely = F.filter(F.regexp_extract_all(F.lower(text), F.lit(_likely_words()), 0), lambda w: F.octet_length(w) >= 2)
    named = F.filter(F.transform(likely, word_topic), lambda t: t.isNotNull())
    names = sorted({*V.keyword_topics().values(), *V.stem_topics().values()})

    def counts(hits: Column) -> Column:
        times = lambda t: F.size(F.filter(hits, lambda h: h == t)).cast("long")
        each = F.array(*[F.struct(times(t).alias("n"), F.lit(t).alias("topic")) for t in names])
        return F.when(F.size(hits) > 0, F.filter(each, lambda c: c["n"] > 0))

    return F.coalesce(let(named, counts), F.array().cast("array<struct<n:bigint,topic:string>>"))


def topics_of(text: Column, most: int = 3) -> Column:
    """The topics with most hits, ties by name; "general" alone if there is none."""
    ranked = F.array_sort(F.transform(counted_topics(text), lambda c: F.struct((-c["n"]).alias("k"), c["topic"].alias("topic"))))
    top = F.slice(F.transform(ranked, lambda c: c["topic"]), 1, most)
    return let(top, lambda t: F.when(F.size(t) > 0, t).otherwise(F.array(F.lit("general"))))


def topic_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, topic, n) of every row; counted where the row is, so repeated and null ids are no special case."""
    return docs.select(F.col(id_col), F.inline(counted_topics(F.col(text_col)))).select(id_col, "topic", "n")


def classify_topics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 3) -> DataFrame:
    """(id, topics, primary_topic, confidence) of every row; ties by name."""
    listed = docs.select(F.col(id_col), topics_of(F.col(text_col), most).alias("topics"))
    primary = F.get("topics", F.lit(0))
    return listed.select(id_col, "topics", primary.alias("primary_topic"), F.when(primary != "general", 0.7).otherwise(0.3).alias("confidence"))


def document_topics(chunk_topics: DataFrame, id_col: str = "doc_id", order: str = "chunk_index", col: str = "topics") -> DataFrame:
    """(id, topics): topics of a document's chunks, each once, in order of first appearance."""
    rows = chunk_topics.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(order, col))).alias("all"))
    return rows.select(id_col, F.array_distinct(F.flatten(F.transform("all", lambda s: s[col]))).alias("topics"))


def metadata_map(raw: Column) -> Column:
    """A JSON object as a map of strings; anything else is an empty map."""
    return F.coalesce(F.from_json(raw, "map<string,string>"), F.create_map().cast("map<string,string>"))


def content_type(text: Column, source: Column | None = None, filename: Column | None = None) -> Column:
    low = F.lower(text)
    name = F.lower(F.coalesce(filename, F.lit(""))) if filename is not None else F.lit("")
    has = lambda c, words: reduce(lambda a, b: a | b, [c.contains(w) for w in words])
    default = reduce(lambda c, kv: c.when(source == kv[0], kv[1]), V.SOURCE_TYPES.items(), F.when(F.lit(False), "")).otherwise("note") if source is not None else F.lit("note")
    return (
        F.when(any_match(low, V.EMAIL_PATTERNS), "email")
        .when(any_match(low, V.LIST_PATTERNS) | has(low, ["todo", "checklist"]), "list")
        .when(any_match(low, V.MEETING_PATTERNS), "meeting")
        .when(has(name, ["readme", "doc"]) & has(low, V.DOCUMENTATION_WORDS), "documentation")
        .when(any_match(text, V.CODE_PATTERNS), "code")
        .when(any_match(low, V.CONVERSATION_PATTERNS), "conversation")
        .otherwise(default)
    )


def domain(text: Column) -> Column:
    """Domain with most keywords present, at least two, the first of equal ones; else personal."""
    low = F.lower(text)
    scores = F.array(*[F.struct(F.aggregate(F.array(*[F.lit(w) for w in words]), F.lit(0), lambda a, w: a + low.contains(w).cast("int")).alias("score"), F.lit(-i).alias("place"), F.lit(name).alias("name")) for i, (name, words) in enumerate(V.DOMAIN_KEYWORDS.items())])
    best = F.array_max(scores)
    return F.when(best["score"] >= 2, best["name"]).otherwise("personal")


def _first(found: Column, most: int | None) -> Column:
    """The first ``most`` values, or all of them."""
    return F.slice(found, 1, most) if most else found


def technologies(text: Column, most: int | None = 5) -> Column:
    # Few names are in a text: a plain search comes first, so few patterns are compiled and tried.
    known = F.filter(F.array(*map(F.lit, V.TECHNOLOGIES)), lambda k: F.contains(text, k) & F.regexp_like(text, F.concat(F.lit(r"(?U)\b\Q"), k, F.lit(r"\E\b"))))
    terms = F.filter(F.concat(F.regexp_extract_all(text, F.lit(UNICODE + V.CAMEL_TECH), 0), F.regexp_extract_all(text, F.lit(UNICODE + V.SNAKE_TECH), 0)), lambda t: F.octet_length(t) > 3)
    return _first(F.array_distinct(F.concat(known, terms)), most)


def activities(text: Column, most: int | None = 5) -> Column:
    """Lower-cased verbs; equal neighbours collapse."""
    found = F.transform(matches(text, V.ACTIVITY_PATTERNS, most and 2 * most), F.lower)
    return _first(let(found, lambda all_: F.filter(all_, lambda x, i: (i == 0) | (x != F.get(all_, i - 1)))), most)


def persons(text: Column, most: int | None = 5) -> Column:
    """Titled names, then pairs of capitalised words that do not start the text."""
    titled = F.regexp_extract_all(text, F.lit(UNICODE + V.TITLED_PERSON), 1)
    pairs = F.regexp_extract_all(text, F.lit(UNICODE + V.TWO_NAMES), 1)
    first_at = F.octet_length(F.left(text, F.regexp_instr(text, F.lit(UNICODE + V.TWO_NAMES)) - 1))

    def listed(found: Column) -> Column:
        titled, pairs = found["titled"], found["pairs"]
        later = F.when((F.size(pairs) > 0) & (first_at <= 2), F.slice(pairs, 2, F.greatest(F.size(pairs), F.lit(1)))).otherwise(pairs)
        return _first(F.concat(titled, F.array_except(later, titled)), most)

    # The text is searched once, not once for each name in it.
    return let(F.struct(titled.alias("titled"), pairs.alias("pairs")), listed)


def organizations(text: Column, most: int | None = 5) -> Column:
    return _first(F.regexp_extract_all(text, F.lit(UNICODE + V.ORGANIZATION), 0), most)


def named_metadata(text: Column, most: int | None = 5) -> Column:
    """The lists that enriched texts name."""
    return F.struct(
        persons(text, most).alias("persons"),
        organizations(text, most).alias("organizations"),
        F.array().cast("array<string>").alias("locations"),
        technologies(text, most).alias("technologies"),
    )


def structured_metadata(text: Column, most: int | None = 5) -> Column:
    """Nine lists of what a text names, of each the first ``most`` or, without it, all."""
    whole = lambda found: F.coalesce(found, F.array().cast("array<string>"))
    return F.struct(
        matches(text, V.DATE_PATTERNS, most).alias("dates"),
        matches(text, V.TIME_PATTERNS, most).alias("times"),
        matches(text, V.TEMPORAL_PATTERNS, most).alias("temporal_refs"),
        matches(text, V.QUANTITY_PATTERNS, most).alias("quantities"),
        whole(technologies(text, most)).alias("technologies"),
        whole(activities(text, most)).alias("activities"),
        whole(persons(text, most)).alias("persons"),
        whole(organizations(text, most)).alias("organizations"),
        F.array().cast("array<string>").alias("locations"),
    )


def _capital(word: Column) -> Column:
    return word.rlike(r"^\p{Lu}") & ~word.rlike(r"^\p{Lu}+$")


def entities(text: Column, most: int = 10) -> Column:
    """Names, technical and quoted terms by how often they occur in the text, ties by name."""
    # Words after the first of a sentence whose first letter or digit is a capital.
    inner = F.flatten(F.transform(sentences(text), lambda s: F.regexp_extract_all(s, F.lit(r"(?U)(?<=\s)[^\s\p{L}\p{N}]*+\p{Lu}\S*"), 0)))
    names = F.filter(F.transform(F.filter(inner, lambda w: F.octet_length(w) > 2), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", "")), _capital)
    terms = [F.regexp_extract_all(text, F.lit(UNICODE + p), 0) for p in (V.CAMEL, V.SNAKE, V.CONSTANT)]
    found = F.array_distinct(F.concat(names, *terms, F.regexp_extract_all(text, F.lit(V.QUOTED), 1)))
    times = lambda low, e: (low["n"] - F.char_length(F.replace(low["text"], F.lower(e), F.lit("")))) / F.char_length(e)
    # The lower-cased text and its length are bound once, not made for each name.
    lowered = F.struct(F.lower(text).alias("text"), F.char_length(F.lower(text)).alias("n"))
    ranked = let(lowered, lambda low: F.sort_array(F.transform(found, lambda e: F.struct((-times(low, e)).alias("k"), e.alias("e")))))
    return F.slice(F.transform(ranked, lambda s: s["e"]), 1, most)


def _sentence_score(sentence: Column, i: Column, total: Column) -> Column:
    hit = lambda c: F.when(c, 1).otherwise(0)
    size = F.octet_length(sentence)
    # Words after the first that begin with a capital and have something else too.
    capitals = F.regexp_count(sentence, F.lit(r"(?U)(?<=\s)\p{Lu}(?!\p{Lu}*+(?:\s|\z))"))
    known = let(F.lower(sentence), lambda low: reduce(lambda a, b: a + b, [hit(low.contains(w)) for w in V.KEY_SENTENCE_WORDS]))
    return (
        F.greatest(F.lit(3) - i, F.lit(0))
        + 2 * hit((total > 5) & (i >= total - 2))
        + F.when((size > 50) & (size < 200), 2).when(size >= 200, 1).otherwise(0)
        + 2 * known
        + F.least(F.lit(3), capitals)
        + hit(sentence.rlike(UNICODE + V.KEY_CAMEL))
        + hit(sentence.rlike(UNICODE + V.KEY_SNAKE))
    )


def best_sentences(text: Column, n: int = 3) -> Column:
    """The ``n`` best sentences in order, from all three thirds of longer texts; the head of a text without any."""
    listed = F.filter(sentences(text), lambda s: F.octet_length(s) > 20)

    def scored(all_: Column) -> Column:
        total = F.size(all_)
        return F.transform(all_, lambda s, i: F.struct((-_sentence_score(s, i, total)).alias("k"), i.alias("i"), s.alias("sentence")))

    def spread(ranked: Column, total: Column) -> Column:
        # Of equal sentences only the best-placed one counts: sorted by sentence, it is the first of its run.
        by_text = F.array_sort(F.transform(ranked, lambda x: F.struct(x["sentence"].alias("sentence"), x["k"].alias("k"), x["i"].alias("i"))))
        first = let(by_text, lambda b: F.filter(F.transform(b, lambda x, j: F.when((j == 0) | (F.get(b, j - 1)["sentence"] != x["sentence"]), F.struct(x["k"].alias("k"), x["i"].alias("i"), x["sentence"].alias("sentence")))), lambda x: x.isNotNull()))
        third = F.floor(total / 3)

        def ordered(once: Column) -> Column:
            head = lambda a, z: F.get(F.filter(once, lambda x: (x["i"] >= a) & (x["i"] < z)), F.lit(0))
            heads = F.array_compact(F.array(head(F.lit(0), third), head(third, 2 * third), head(2 * third, total)))
            return let(heads, lambda h: F.concat(h, F.filter(once, lambda x: ~F.exists(h, lambda y: y["i"] == x["i"]))))

        return let(F.array_sort(first), ordered)

    def best(all_: Column) -> Column:
        total = F.size(all_)
        ranked = let(F.array_sort(scored(all_)), lambda r: F.when((total > 10) & F.lit(n >= 3), spread(r, total)).otherwise(r))
        return F.transform(F.slice(ranked, 1, n), lambda x: x["sentence"])

    return let(listed, lambda a: F.when(F.size(a) > 0, best(a)).otherwise(F.array(F.left(text, F.lit(500)))))


def key_sentences(docs: DataFrame, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rank, sentence) of every row; ranked where the row is, so nothing is shuffled."""
    each = docs.select(F.col(id_col), F.posexplode(best_sentences(F.col(text_col), n)).alias("i", "sentence"))
    return each.select(id_col, (F.col("i") + 1).alias("rank"), "sentence")


def enriched_text(topics: Column, names: Column, passages: Column, meta: Column) -> Column:
    """One line of labelled parts; empty parts are left out."""
    part = lambda label, values, sep: F.when(F.size(values) > 0, F.concat(F.lit(f"{label}: "), F.array_join(values, sep)))
    return F.concat_ws(
        " | ",
        part("topics", topics, " "),
        part("entities", names, " "),
        F.when(F.size(passages) > 0, F.concat(F.lit("passages: "), F.left(F.array_join(passages, " "), F.lit(500)))),
        *[part(k, meta[k], " ") for k in ("persons", "organizations", "locations", "technologies")],
    )


def truncate_text(text: Column, most: int = 500) -> Column:
    return F.when(F.octet_length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def passage(text: Column, query: str, window: int = 200) -> Column:
    """The text around the first query term that occurs, widened to words; dots mark cuts."""
    low = F.lower(text)
    places = [F.when(F.locate(t.lower(), low) > 0, F.locate(t.lower(), low) - 1) for t in query.split()]
    at = F.coalesce(*places, F.lit(0))
    n = F.char_length(text)
    left, right = F.greatest(at - window, F.lit(0)), F.least(at + window, n)
    before, after = F.left(text, left), F.substring(text, right + 1, n)
    cut = F.char_length(F.substring_index(before, " ", -1))
    start = F.when(F.contains(before, F.lit(" ")), left - cut).otherwise(left)
    gap = F.locate(" ", after)
    end = F.when(gap > 0, right + gap - 1).otherwise(right)
    return F.concat(F.when(start > 0, "...").otherwise(""), F.substring(text, start + 1, end - start), F.when(end < n, "...").otherwise(""))


def safe_title(title: Column) -> Column:
    return F.left(F.regexp_replace(title, r"[^\p{L}\p{N} \-]", "_"), F.lit(50))


def sanitize_filename(name: Column) -> Column:
    """A name without folders and parent steps; "unnamed" if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(name, r"[/\\\\]", ""), r"\.\.", "")
    return F.when(bare.isin("", "."), "unnamed").otherwise(bare)


def unique_filename(name: Column, taken: Column, stamp: str) -> Column:
    """A sanitized name, with ``stamp`` before its extension where the name is ``taken``."""
    safe = sanitize_filename(name)
    # As for paths, a leading dot begins no extension.
    parts = lambda k: F.regexp_extract(safe, r"^(.+?)(?:\.([^.]*))?$", k)
    marked = F.concat(parts(1), F.lit(f"_{stamp}"), F.when(parts(2) != "", F.concat(F.lit("."), parts(2))).otherwise(F.lit("")))
    return F.when(taken, marked).otherwise(safe)
