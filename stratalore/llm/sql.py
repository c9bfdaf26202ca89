"""SQL of the queries that SQL can express, over the driver's tables."""

from __future__ import annotations

from stratalore.llm import line_quality as lq
from stratalore.llm import mixing

_WORD = "[^\\x20\\x09-\\x0D]+"
_text = lambda s: s.replace("'", "''")
_count = lambda x, p: f"len(regexp_extract_all({x}, '{_text(p)}'))"

_CLOSING = _text(lq.CLOSING).replace("u2026", "x{2026}").replace("u201d", "x{201d}").replace("u00bb", "x{00bb}")

QUALITY_RULES = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, x, regexp_extract_all(x, '{_WORD}') AS ws FROM d),
places AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i + 7], ' ')) AS n FROM places),
rep AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS c FROM win WHERE n > 1),
repeats AS (SELECT doc_id, CAST(sum(c) AS BIGINT) AS n_repeat_words FROM rep GROUP BY 1),
l AS (SELECT doc_id, unnest(string_split(x, chr(10))) AS line FROM d),
m AS (SELECT DISTINCT doc_id, line, {_count("line", _WORD)} AS n, {_count("line", "[|]")} AS bars, {_count("line", lq.SYMBOLS)} AS marks, {_count("line", "!!")} AS shouts FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
j AS (SELECT *, (bars >= 2 AND bars * 3 >= n) OR (n BETWEEN 2 AND 6 AND regexp_matches(line, '{_text(lq.MENU)}')) OR marks * 3 > n OR (n >= 3 AND shouts * 2 > n) OR regexp_matches(lower(line), '{_text(lq.BOILERPLATE)}')
   OR (n < {lq.TEASER_WORDS} AND regexp_matches(line, '{_text(lq.TEASER)}')) OR (NOT regexp_matches(line, '{_CLOSING}') AND (n < {lq.FRAGMENT_WORDS} OR (n <= {lq.BULLET_WORDS} AND regexp_matches(line, '{_text(lq.BULLET)}')))) AS bad FROM m),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
ls AS (SELECT doc_id, coalesce(sum(n) FILTER (NOT bad), 0) AS clean_words FROM j GROUP BY 1),
f AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST({_count("x", lq.SYMBOLS)} AS BIGINT) AS n_symbols,
   coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(len(ws) - coalesce(clean_words, 0) AS BIGINT) AS lost_words FROM w LEFT JOIN repeats USING (doc_id) LEFT JOIN ls USING (doc_id) LEFT JOIN dup USING (doc_id)),
b AS (SELECT *, n_words < {lq.MIN_WORDS} OR 100 * n_repeat_words > {lq.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * lost_words <= {lq.MAX_LOST_PERCENT} * n_words AS kept, lost_words FROM b
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS hex FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex, payload_bytes) AS first FROM d),
b AS (SELECT *, CAST(CAST(unhex(hex) AS BIT) AS VARCHAR) AS bits FROM f)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1
           + 16 * CAST(substr(bits, CAST(5 * i + 1 AS BIGINT), 1) AS INT) + 8 * CAST(substr(bits, CAST(5 * i + 2 AS BIGINT), 1) AS INT)
           + 4 * CAST(substr(bits, CAST(5 * i + 3 AS BIGINT), 1) AS INT) + 2 * CAST(substr(bits, CAST(5 * i + 4 AS BIGINT), 1) AS INT)
           + CAST(substr(bits, CAST(5 * i + 5 AS BIGINT), 1) AS INT) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""

_LOW = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_LOW} AS ws FROM documents),
b AS (SELECT item_id, {_LOW} AS ws FROM benchmark),
bp AS (SELECT item_id, ws, least(13, len(ws)) AS n, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0),
pat AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS k FROM bp),
sizes AS (SELECT DISTINCT n FROM pat),
dp AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes),
found AS (SELECT doc_id, i, dw.n, item_id FROM (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS k FROM dp) dw JOIN pat USING (n, k)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

_d = lambda x: f"CAST({x} AS DOUBLE)"
_RATIO = "ORDER BY cap / w, source NULLS LAST"

MIXING = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS x, CAST({_count("coalesce(text, '')", _WORD)} AS BIGINT) AS size FROM documents),
k AS (SELECT doc_id, source, size, -ln(({_d("CAST('0x' || left(md5(CAST(doc_id AS VARCHAR) || ':' || x), 12) AS BIGINT)")} + {_d(0.5)}) / {_d("281474976710656")})
      / greatest({_d(0.1)}, {_d(1)} - {_d(_count("x", mixing.SYMBOL))} / {_d("greatest(size, 1)")}) AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
r AS (SELECT *, {_d(f"{list(mixing.WEIGHTS)}[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)}]")} AS w, {_d(f"{mixing.MOST} * source_size")} AS cap FROM s),
lv AS (SELECT *, (sum({_d("source_size")}) OVER () * {_d(mixing.SHARE)} - coalesce(sum(cap) OVER ({_RATIO} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER ({_RATIO} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
free AS (SELECT min_by(level, cap / w) AS free FROM lv WHERE level * w <= cap),
g AS (SELECT source, source_size, CASE WHEN free IS NULL THEN cap ELSE least(cap, free * w) END AS target FROM lv, free),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM g),
u AS (SELECT k.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest, sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size > 0 THEN size * (epochs + CASE WHEN upto - {_d("size")} / 2 <= rest AND epochs < {mixing.MOST} THEN 1 ELSE 0 END) ELSE 0 END AS BIGINT) AS taken FROM u
"""

HARD_NEGATIVES = """
WITH v AS (
    SELECT row_number() OVER () AS place, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS parts
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.place AS anchor, a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
        CAST(coalesce(list_sum(list_transform(list_zip(a.parts, b.parts), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
    FROM v a JOIN v b ON a.place <> b.place WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT anchor, anchor_id, other_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other_id NULLS LAST) AS pair
    FROM scored WHERE same QUALIFY pair <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.pair ORDER BY s.score DESC, s.other_id NULLS LAST) AS INTEGER) AS rank,
    s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor = p.anchor AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""

_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
RANKED_SEARCH = f"""
WITH d AS (
    SELECT row_number() OVER () AS place, doc_id, {_TERMS} AS terms FROM documents
), n AS (
    SELECT place, doc_id, CAST(len(terms) AS BIGINT) AS n FROM d WHERE len(terms) > 0
), corpus AS (
    SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n
), tf AS (
    SELECT place, term, count(*) AS tf FROM (SELECT place, unnest(terms) AS term FROM d) GROUP BY place, term
), w AS (
    SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, corpus GROUP BY term, docs
), items AS (
    SELECT place, item_id, term, count(*) AS times
    FROM (SELECT place, item_id, unnest(terms) AS term FROM (SELECT row_number() OVER () AS place, item_id, {_TERMS} AS terms FROM benchmark)) GROUP BY ALL
), scored AS (
    SELECT items.place AS item, item_id, doc_id, n.place AS place,
        CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // corpus.terms)))) AS BIGINT) AS score
    FROM items JOIN tf USING (term) JOIN w USING (term) JOIN n ON n.place = tf.place, corpus GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""
