"""Queries over the driver's tables, one for each operator, and their SQL where SQL can say it.

``documents`` stands in for the document table (doc_id for id and for the time of
creation), ``conversations`` for chunks of a document in order, ``embeddings`` for
chunk vectors and ``events`` for job logs and captures.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalore.functions import privacy
from stratalore.functions import text as X
from stratalore.functions import vectors as VEC
from stratalore.functions import vocabulary as V
from stratalore.functions.chunking import chunk_documents
from stratalore.operators import consent, graph, jobs, pages, search, vector_matrix
from stratalore.operators import store as S
from stratalore.sources import connectors
from stratalore.streaming import ingest as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: The lists of structured metadata.
METADATA = ("dates", "times", "temporal_refs", "quantities", "technologies", "activities", "persons", "organizations", "locations")
#: Words that the keyword queries look for, and the vector that the vector queries start from.
WORDS, QUERY_VECTOR = "the nicht", 0


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents")


# Lookups, pages, sets

@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def doc_content_hash(spark, d):
    return docs(spark, d).select("doc_id", X.content_hash(F.col("text")).alias("content_hash"))


@query("SELECT doc_id, source, lang FROM documents WHERE doc_id = 7")
def doc_by_id(spark, d):
    return S.get_by_id(docs(spark, d), 7, "doc_id").select("doc_id", "source", "lang")


@query("SELECT count(*) AS n FROM documents WHERE sha256(text) = (SELECT sha256(text) FROM documents WHERE doc_id = 5)")
def docs_by_hash(spark, d):
    hashed = docs(spark, d).withColumn("content_hash", X.content_hash(F.col("text")))
    wanted = hashed.where("doc_id = 5").select("content_hash")
    return hashed.join(wanted, "content_hash", "left_semi").agg(F.count("*").alias("n"))


@query("SELECT doc_id, source FROM documents ORDER BY doc_id DESC LIMIT 5 OFFSET 10")
def docs_page(spark, d):
    return S.page(docs(spark, d), 3, 5, by="doc_id", key="doc_id").select("doc_id", "source")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id DESC LIMIT 10 OFFSET 140")
def deep_page(spark, d):
    """A page far behind the first, from a directory of ranges: only the ranges that it lies in are read."""
    return pages.PageDirectory.create(docs(spark, d).select("doc_id", "n_chars"), by="n_chars", key="doc_id").page(15, 10)


@query("SELECT count(*) AS total, CAST(ceil(count(*) / 10.0) AS BIGINT) AS total_pages FROM documents")
def docs_page_count(spark, d):
    return S.page_count(docs(spark, d))


@query("SELECT sha256(text) AS content_hash, count(*) AS n, max(doc_id) AS newest FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark, d):
    return docs(spark, d).groupBy(X.content_hash(F.col("text")).alias("content_hash")).agg(F.count("*").alias("n"), F.max("doc_id").alias("newest")).where("n > 1")


@query("SELECT max(doc_id) AS doc_id FROM documents GROUP BY sha256(text)")
def dedup_keep_newest(spark, d):
    return S.deduplicate(docs(spark, d).withColumn("content_hash", X.content_hash(F.col("text"))), newest="doc_id").select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 25)")
def evict_oldest(spark, d):
    return S.evict_oldest(docs(spark, d), 25, by="doc_id", key="doc_id").select("doc_id")


@query("SELECT min(doc_id) AS doc_id FROM documents WHERE source <> 'src0' AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE source = 'src0') GROUP BY sha256(text)")
def add_new_documents(spark, d):
    rows = docs(spark, d).withColumn("content_hash", X.content_hash(F.col("text")))
    return S.new_documents(rows.where("source = 'src0'"), rows.where("source <> 'src0'"), "doc_id").select("doc_id")


@query("SELECT (SELECT count(DISTINCT sha256(text)) FROM documents) AS added, (SELECT count(*) - count(DISTINCT sha256(text)) FROM documents) AS duplicates, CAST(0 AS BIGINT) AS errors")
def batch_add_tallies(spark, d):
    incoming = docs(spark, d).select("text", F.create_map(F.lit("source"), F.col("source")).alias("metadata"))
    return S.add_documents(S.Store.create(spark), incoming)[1]


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabeled_docs(spark, d):
    return docs(spark, d).join(t(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("SELECT l.doc_id FROM labels l JOIN documents d USING (doc_id) WHERE d.lang = 'en'")
def cascade_keep(spark, d):
    return t(spark, d, "labels").join(docs(spark, d).where("lang = 'en'"), "doc_id", "left_semi").select("doc_id")


@query("SELECT d.doc_id, d.source AS source, CASE WHEN l.doc_id IS NULL THEN d.lang ELSE CAST(l.quality AS VARCHAR) END AS lang, l.doc_id IS NOT NULL AS changed FROM documents d LEFT JOIN labels l USING (doc_id)")
def metadata_merge(spark, d):
    base = docs(spark, d).select(F.col("doc_id").alias("id"), F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang")).alias("metadata"), F.lit(None).cast("long").alias("updated_at"))
    new = t(spark, d, "labels").select(F.col("doc_id").alias("id"), F.create_map(F.lit("lang"), F.col("quality").cast("string")).alias("metadata"))
    out = S.merge_metadata(base, new, 1)
    return out.select(F.col("id").alias("doc_id"), F.element_at("metadata", "source").alias("source"), F.element_at("metadata", "lang").alias("lang"), F.map_contains_key("metadata", "metadata_updated_at").alias("changed"))


@query("SELECT count(*) AS documents, CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(DISTINCT source) AS sources, count(*) FILTER (lang = 'en') AS english FROM documents")
def collection_stats(spark, d):
    return docs(spark, d).agg(F.count("*").alias("documents"), F.sum(F.octet_length("text")).alias("bytes"), F.countDistinct("source").alias("sources"), F.count_if(F.col("lang") == "en").alias("english"))


# Chunks

@query("SELECT doc_id, CASE WHEN strlen(text) < 2000 THEN false ELSE strlen(text) > 3000 END AS plain, CASE WHEN strlen(text) < 2000 THEN false ELSE strlen(text) > 5000 END AS code, strlen(text) > 2000 AS markdown FROM documents")
def should_chunk_flags(spark, d):
    c = F.col("text")
    return docs(spark, d).select("doc_id", X.should_chunk(c).alias("plain"), X.should_chunk(c, F.lit(".py")).alias("code"), X.should_chunk(c, F.lit(".MD")).alias("markdown"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 400 WHEN 1 THEN 600 ELSE 512 END AS size, CASE doc_id % 4 WHEN 0 THEN 80 WHEN 1 THEN 120 ELSE 100 END AS overlap FROM documents")
def chunk_size_policy(spark, d):
    ext = F.get(F.array(*map(F.lit, [".rs", ".TXT", ".html", ".csv"])), (F.col("doc_id") % 4).cast("int"))
    return docs(spark, d).select("doc_id", X.chunk_size(ext).alias("size"), X.chunk_overlap(ext).alias("overlap"))


@query("SELECT doc_id, CAST(1 AS BIGINT) AS n, CAST(strlen(text) AS BIGINT) AS bytes FROM documents WHERE strlen(text) <= 3000 AND NOT (strlen(text) BETWEEN 2000 AND 3000 AND strlen(text) > 3000)")
def whole_chunks(spark, d):
    chunks = chunk_documents(docs(spark, d)).where("parent_index is null and level = 1")
    return chunks.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))


@query()
def chunks(spark, d):
    return chunk_documents(docs(spark, d))


@query("SELECT a.conv_id, a.turn, (SELECT string_agg(b.text, '|' ORDER BY b.turn) FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn BETWEEN a.turn - 1 AND a.turn + 1) AS context FROM conversations a")
def surrounding_chunks(spark, d):
    out = S.surrounding(t(spark, d, "conversations"), 1, "conv_id", None, "turn", "text")
    return out.select("conv_id", "turn", F.array_join("context", "|").alias("context"))


@query("SELECT c.conv_id, c.turn, p.text AS parent_text FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = 0 AND c.turn > 0")
def parent_context(spark, d):
    c = t(spark, d, "conversations")
    ids = c.select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.when(F.col("turn") > 0, F.concat_ws(":", "conv_id", F.lit(0))).alias("parent_chunk_id"), "conv_id", "turn", "text")
    return S.parents(ids).select("conv_id", "turn", "parent_text")


@query("SELECT turn, text FROM conversations WHERE conv_id = 3 AND turn <> 1")
def sibling_chunks(spark, d):
    c = t(spark, d, "conversations").where("conv_id = 3")
    ids = c.select(F.col("turn").alias("id"), F.col("turn").alias("chunk_index"), F.col("conv_id").alias("parent_chunk_id"), "turn", "text")
    return S.siblings(ids, 1).select("turn", "text")


# Keyword, vector and hybrid search

_TERMS = "SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM documents"
_BM25 = f"""
t AS ({_TERMS}), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
len AS (SELECT d.doc_id, coalesce(l, 0) AS l FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS l FROM t GROUP BY 1) USING (doc_id)),
tot AS (SELECT count(*) AS n, avg(l) AS a FROM len), hit AS (SELECT * FROM tf WHERE term IN ('the', 'nicht')),
df AS (SELECT term, count(*) AS df FROM hit GROUP BY 1),
bm AS (SELECT doc_id, sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))) AS score
       FROM hit JOIN df USING (term) JOIN len USING (doc_id), tot GROUP BY 1)"""


@query(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, doc_id LIMIT 10")
def bm25_topk(spark, d):
    index = search.shared_index(docs(spark, d), False, "doc_id")
    return search.bm25(index, WORDS, 10).select(F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM bm")
def bm25_after_changes(spark, d):
    """All scores from an index that began as another table and followed its changes: rows added, replaced and deleted."""
    now = docs(spark, d).select("doc_id", "text")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(50))
    before = now.where(part != 0).withColumn("text", F.when(part == 1, F.concat(F.lit("the old "), F.reverse("text"))).otherwise(F.col("text")))
    gone = now.where(part == 2).select((-F.col("doc_id") - 1).alias("doc_id"), "text")
    index = search.build_index(before.unionByName(gone), False, "doc_id")
    index = index.apply(now.where(part <= 1)).apply(None, gone)
    return search.bm25(index, WORDS, None).select(F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"))


@query()
def bm25_porter_topk(spark, d):
    index = search.shared_index(docs(spark, d), True, "doc_id")
    return search.bm25(index, "thing. node.js Ation", 10).select(F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"))


def _vector(spark, d) -> list[float]:
    return list(t(spark, d, "embeddings").where(F.col("vec_id") == QUERY_VECTOR).first().embedding)


_COS = "cos AS (SELECT e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"


@query(f"WITH {_COS} SELECT vec_id, round(score, 6) AS score FROM cos ORDER BY cos.score DESC, vec_id LIMIT 10")
def vector_topk(spark, d):
    hits = search.vector_search(t(spark, d, "embeddings"), _vector(spark, d), 10, "vec_id", "embedding")
    return hits.select(F.col("chunk_id").alias("vec_id"), F.round("score", 6).alias("score"))


@query(f"WITH {_COS} SELECT vec_id, round(score, 6) AS score FROM cos ORDER BY cos.score DESC, vec_id LIMIT 10")
def matrix_topk(spark, d):
    """Exact search in a written matrix that began as another table: vectors appended, replaced and deleted."""
    now = t(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    part = F.pmod(F.xxhash64("chunk_id"), F.lit(20))
    before = now.where(part != 0).withColumn("vector", F.when(part == 1, F.reverse("vector")).otherwise(F.col("vector")))
    gone = now.where(part == 2).select((-F.col("chunk_id") - 1).alias("chunk_id"), "vector")
    matrix = vector_matrix.VectorMatrix.create(before.unionByName(gone)).append(now.where(part <= 1)).delete(gone)
    return matrix.search(_vector(spark, d), 10).select(F.col("chunk_id").alias("vec_id"), F.round("score", 6).alias("score"))


_QUANT = "q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, list_min(CAST(embedding AS DOUBLE[])) AS lo, (list_max(CAST(embedding AS DOUBLE[])) - list_min(CAST(embedding AS DOUBLE[]))) / 255 AS s FROM embeddings)"


@query(f"WITH {_QUANT} SELECT vec_id, array_to_string(list_transform(v, lambda x: CAST(greatest(0, least(255, floor((x - lo) / s + 0.5))) AS INT)), ',') AS codes, round(s, 9) AS scale, round(lo, 9) AS \"offset\" FROM q")
def quantize(spark, d):
    q = t(spark, d, "embeddings").select("vec_id", VEC.quantize(F.col("embedding")).alias("q"))
    return q.select("vec_id", F.array_join("q.codes", ",").alias("codes"), F.round("q.scale", 9).alias("scale"), F.round("q.offset", 9).alias("offset"))


@query(f"WITH {_QUANT} SELECT vec_id, round(list_max(list_transform(v, lambda x: abs(x - (floor((x - lo) / s + 0.5) * s + lo)))), 9) AS worst, true AS within FROM q")
def dequantize_error(spark, d):
    q = t(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), VEC.quantize(F.col("embedding")).alias("q"))
    err = F.array_max(F.zip_with("v", VEC.dequantize(F.col("q.codes"), F.col("q.scale"), F.col("q.offset")), lambda a, b: F.abs(a - b)))
    return q.select("vec_id", F.round(err, 9).alias("worst"), (err <= F.col("q.scale") / 2 + 1e-9).alias("within"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS norm FROM embeddings")
def vector_norms(spark, d):
    return t(spark, d, "embeddings").select("vec_id", F.round(VEC.norm(F.col("embedding")), 6).alias("norm"))


_FUSED = f"""WITH {_BM25}, {_COS},
a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM bm QUALIFY r <= 20),
b AS (SELECT vec_id AS id, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM cos QUALIFY r <= 20),
f AS (SELECT id, sum(1.0 / (60 + r)) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id)"""


def _hybrid(spark, d) -> DataFrame:
    index = search.shared_index(docs(spark, d), False, "doc_id")
    vectors = t(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    return search.hybrid_search(index, vectors, WORDS, _vector(spark, d), 20, 20)


@query(f"{_FUSED} SELECT id AS doc_id, round(score, 6) AS score FROM f")
def hybrid_topk(spark, d):
    return _hybrid(spark, d).select(F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"{_FUSED} SELECT id AS doc_id, round(score + CASE WHEN contains(lower(text), 'nicht') OR contains(lower(text), 'the') THEN 0.15 ELSE 0 END, 6) AS score FROM f JOIN documents ON doc_id = id")
def entity_boost(spark, d):
    hits = docs(spark, d).join(F.broadcast(_hybrid(spark, d)), F.col("doc_id") == F.col("chunk_id"))
    return search.entity_boost(hits, WORDS, "text").select("doc_id", F.round("score", 6).alias("score"))


@query(f"{_FUSED} SELECT id AS doc_id, round(score + 0.15 * (CAST(contains(lower(text), 'nicht') AS INT) + CAST(contains(lower(text), 'the') AS INT)) / 2.0, 6) AS score FROM f JOIN documents ON doc_id = id")
def entity_resolve(spark, d):
    hits = docs(spark, d).join(F.broadcast(_hybrid(spark, d)), F.col("doc_id") == F.col("chunk_id"))
    return search.entity_rank(hits, WORDS).select("doc_id", F.round("score", 6).alias("score"))


@query("SELECT conv_id, turn, strlen(text) AS score FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY strlen(text) DESC, turn) = 1 ORDER BY score DESC, turn, conv_id LIMIT 1000000")
def best_chunk_per_doc(spark, d):
    hits = t(spark, d, "conversations").select("conv_id", F.col("turn").alias("chunk_id"), F.octet_length("text").cast("long").alias("score"))
    return search.best_per_document(hits, None, "conv_id").select("conv_id", F.col("chunk_id").alias("turn"), "score")


_PASSAGE = """
WITH p AS (SELECT doc_id, text, coalesce(nullif(strpos(lower(text), 'nicht'), 0) - 1, nullif(strpos(lower(text), 'the'), 0) - 1, 0) AS pos, length(text) AS n FROM documents),
e AS (SELECT *, greatest(pos - 200, 0) AS l, least(pos + 200, n) AS r FROM p),
w AS (SELECT *, CASE WHEN contains(left(text, l), ' ') THEN l - strpos(reverse(left(text, l)), ' ') + 1 ELSE l END AS s,
      CASE WHEN strpos(substr(text, r + 1), ' ') > 0 THEN r + strpos(substr(text, r + 1), ' ') - 1 ELSE r END AS z FROM e)
SELECT doc_id, CASE WHEN s > 0 THEN '...' ELSE '' END || substr(text, s + 1, z - s) || CASE WHEN z < n THEN '...' ELSE '' END AS passage FROM w
"""


@query(_PASSAGE)
def passages(spark, d):
    return docs(spark, d).select("doc_id", X.passage(F.col("text"), "nicht the").alias("passage"))


_PROMPT_SQL = f"""{_FUSED}, c AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS i, source, CASE WHEN strlen(text) > 500 THEN left(text, 500) || '...' ELSE text END AS x FROM f JOIN documents ON doc_id = id WHERE score >= 0.0125)
SELECT '{{head}}' || string_agg('[' || i || '] (source: ' || source || '): ' || x, chr(10) || chr(10) ORDER BY i) || '{{tail}}' AS prompt FROM c""".format(
    head=V.PROMPT_HEAD.replace("'", "''"), tail=V.PROMPT_TAIL.replace("'", "''")
)


@query(_PROMPT_SQL)
def rag_prompt(spark, d):
    hits = docs(spark, d).join(F.broadcast(_hybrid(spark, d)), F.col("doc_id") == F.col("chunk_id"))
    return search.rag_prompt(search.rag_context(hits, 0.0125))


# Text analysis

_STEM = " ".join(f"WHEN strlen(w) > {len(s) + 1} AND ends_with(w, '{s}') THEN left(w, length(w) - {len(s)}) || '{p}'" for s, p in V.STEM_RULES)
_MAP = lambda m: ", ".join(f"('{k}', '{v}')" for k, v in sorted(m.items()))
_TOPICS = f"""
words AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[\\s,.;:!?()\\[\\]{{}}"''/\\\\]+'), lambda x: strlen(x) >= 2)) AS w FROM documents),
voc AS (SELECT DISTINCT w FROM words), ex(k, t) AS (VALUES {_MAP(V.keyword_topics())}), st(k, t) AS (VALUES {_MAP(V.stem_topics())}),
stem AS (SELECT w, CASE WHEN strlen(w) <= 3 THEN w {_STEM} ELSE w END AS s FROM voc),
named AS (SELECT stem.w, coalesce(ex.t, st.t) AS topic FROM stem LEFT JOIN ex ON ex.k = stem.w LEFT JOIN st ON st.k = stem.s WHERE coalesce(ex.t, st.t) IS NOT NULL),
tc AS (SELECT doc_id, topic, count(*) AS n FROM words JOIN named USING (w) GROUP BY ALL)"""


@query(f"SELECT w AS word, CASE WHEN strlen(w) <= 3 THEN w {_STEM} ELSE w END AS stem FROM (SELECT DISTINCT unnest(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '')) AS w FROM documents)")
def light_stems(spark, d):
    words = docs(spark, d).select(F.explode(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != "")).alias("word")).distinct()
    return words.select("word", X.light_stem(F.col("word")).alias("stem"))


@query(f"WITH {_TOPICS} SELECT doc_id, topic, n FROM tc")
def topic_counts(spark, d):
    return X.topic_counts(docs(spark, d))


@query(f"""WITH {_TOPICS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, topic) AS i FROM tc QUALIFY i <= 3),
l AS (SELECT doc_id, string_agg(topic, ',' ORDER BY i) AS ts, min(topic) FILTER (i = 1) AS p FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(ts, 'general') AS topics, coalesce(p, 'general') AS primary_topic, CASE WHEN ts IS NULL THEN 0.3 ELSE 0.7 END AS confidence FROM documents d LEFT JOIN l USING (doc_id)""".replace("0.3 ELSE 0.7 END", "CAST(0.3 AS DOUBLE) ELSE CAST(0.7 AS DOUBLE) END"))
def topic_classify(spark, d):
    return X.classify_topics(docs(spark, d)).withColumn("topics", F.array_join("topics", ","))


@query(f"WITH {_TOPICS}, a AS (SELECT d.doc_id, coalesce(topic, 'general') AS topic FROM documents d LEFT JOIN (SELECT * FROM tc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, topic) <= 3) USING (doc_id)) SELECT topic, count(*) AS n FROM a GROUP BY 1")
def topic_histogram(spark, d):
    return X.classify_topics(docs(spark, d)).select(F.explode("topics").alias("topic")).groupBy("topic").agg(F.count("*").alias("n"))


@query(f"WITH {_TOPICS} SELECT doc_id FROM tc WHERE topic = 'education' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, topic) <= 3")
def docs_by_topic(spark, d):
    return X.classify_topics(docs(spark, d)).where(F.array_contains("topics", "education")).select("doc_id")


_DOMAIN = "WITH s AS (SELECT doc_id, [" + ", ".join("(" + " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in ws) + ")" for ws in V.DOMAIN_KEYWORDS.values()) + "] AS sc FROM documents)\nSELECT doc_id, CASE WHEN list_max(sc) >= 2 THEN ([" + ", ".join(f"'{k}'" for k in V.DOMAIN_KEYWORDS) + "])[list_position(sc, list_max(sc))] ELSE 'personal' END AS domain FROM s"


@query(_DOMAIN)
def domain_classify(spark, d):
    return docs(spark, d).select("doc_id", X.domain(F.col("text")).alias("domain"))


# Regular expressions of DuckDB have ASCII classes and ASCII word boundaries. Classes are spelled out below; where a
# pattern has a word boundary, letters and marks beyond ASCII are replaced by an ASCII word character that it can't match.
_SPACES = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_CLASSES = {"s": _SPACES, "d": r"\p{Nd}", "w": r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}"}


def _unicode(pattern: str) -> str:
    """A pattern with its Unicode classes spelled out, quoted for SQL."""
    out, inside, i = "", False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            k = pattern[i + 1]
            name = _CLASSES.get(k.lower()) if k in "sdwS" else None
            out += (name if inside else f"[{'^' * (k == 'S')}{name}]") if name else c + k
            i += 2
            continue
        inside = c == "[" or (inside and c != "]")
        out += c
        i += 1
    return out.replace("'", "''")


def _bounded(col: str, mark: str = "_") -> str:
    """SQL that puts an ASCII word character in place of each letter or mark beyond ASCII."""
    return rf"regexp_replace({col}, '[^\x00-\x7F\P{{L}}]|[^\x00-\x7F\P{{M}}]', '{mark}', 'g')"


_ALL = "(SELECT doc_id, text AS raw, coalesce(text, '') AS text FROM documents)"
_any = lambda col, ps: "(" + " OR ".join(f"regexp_matches({col}, '{_unicode(p)}')" for p in ps) + ")"


@query(f"""WITH x AS (SELECT doc_id, lower({_bounded('text')}) AS low, {_bounded('text')} AS text FROM {_ALL})
SELECT doc_id, CASE WHEN {_any('low', V.EMAIL_PATTERNS)} THEN 'email' WHEN {_any('low', V.LIST_PATTERNS)} OR contains(low, 'todo') OR contains(low, 'checklist') THEN 'list'
WHEN {_any('low', V.MEETING_PATTERNS)} THEN 'meeting' WHEN {_any('text', V.CODE_PATTERNS)} THEN 'code' WHEN {_any('low', V.CONVERSATION_PATTERNS)} THEN 'conversation' ELSE 'note' END AS content_type FROM x""")
def content_type(spark, d):
    return docs(spark, d).select("doc_id", X.content_type(F.col("text"), F.col("source")).alias("content_type"))


_SENT = f"""sent AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])([ \\t\\n\\r\\f])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: regexp_replace(x, '^[{_SPACES}]+|[{_SPACES}]+$', '', 'g')), lambda x: x <> '') AS s FROM {_ALL})"""


@query(f"WITH {_SENT} SELECT doc_id, CAST(len(s) AS BIGINT) AS n, sha256(array_to_string(s, '|')) AS digest FROM sent")
def sentence_split(spark, d):
    s = X.sentences(F.col("text"))
    return docs(spark, d).select("doc_id", F.size(s).cast("long").alias("n"), F.sha2(F.array_join(s, "|"), 256).alias("digest"))


_KEY = f"""WITH {_SENT}, l AS (SELECT doc_id, list_filter(s, lambda x: strlen(x) > 20) AS s FROM sent),
e AS (SELECT doc_id, len(s) AS total, unnest(s) AS sentence, unnest(range(len(s))) AS i FROM l WHERE len(s) > 0),
sc AS (SELECT *, greatest(3 - i, 0) + CASE WHEN total > 5 AND i >= total - 2 THEN 2 ELSE 0 END + CASE WHEN strlen(sentence) > 50 AND strlen(sentence) < 200 THEN 2 WHEN strlen(sentence) >= 200 THEN 1 ELSE 0 END
 + 2 * ({" + ".join(f"CAST(contains(lower(sentence), '{w}') AS INT)" for w in V.KEY_SENTENCE_WORDS)})
 + least(3, len(list_filter((string_split_regex(sentence, '[{_SPACES}]+'))[2:], lambda w: regexp_matches(w, '^\\p{{Lu}}') AND NOT regexp_matches(w, '^\\p{{Lu}}+$'))))
 + CAST(regexp_matches({_bounded('sentence', '0')}, '{V.KEY_CAMEL}') AS INT) + CAST(regexp_matches({_bounded('sentence', '0')}, '{V.KEY_SNAKE}') AS INT) AS score,
 CASE WHEN i < total // 3 THEN 0 WHEN i < 2 * (total // 3) THEN 1 ELSE 2 END AS part FROM e),
o AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id, sentence ORDER BY score DESC, i) = 1 OR total <= 10),
p AS (SELECT *, CASE WHEN total > 10 AND row_number() OVER (PARTITION BY doc_id, part ORDER BY score DESC, i) = 1 THEN part ELSE 3 END AS place FROM o),
r AS (SELECT doc_id, sentence, row_number() OVER (PARTITION BY doc_id ORDER BY place, score DESC, i) AS rank FROM p)
SELECT doc_id, CAST(rank AS INT) AS rank, sentence FROM r WHERE rank <= 3
UNION ALL SELECT l.doc_id, 1, left(text, 500) FROM l JOIN documents USING (doc_id) WHERE len(s) = 0"""


@query(_KEY)
def key_sentences(spark, d):
    return X.key_sentences(docs(spark, d), 3)


def _extract_sql(patterns: list[str]) -> str:
    lists = ", ".join(f"regexp_extract_all(text, '{_unicode(p)}')" for p in patterns)
    flat = f"flatten([{lists}])"
    return f"SELECT doc_id, array_to_string(list_slice(list_filter({flat}, lambda x, i: list_position({flat}, x) = i), 1, 5), '|') AS found FROM (SELECT doc_id, {_bounded('text')} AS text FROM {_ALL})"


def _extracted(spark, d, patterns: list[str]) -> DataFrame:
    return docs(spark, d).select("doc_id", F.array_join(X.matches(F.col("text"), patterns, 5), "|").alias("found"))


@query(_extract_sql(V.DATE_PATTERNS))
def dates(spark, d):
    return _extracted(spark, d, V.DATE_PATTERNS)


@query(_extract_sql(V.TIME_PATTERNS))
def times(spark, d):
    return _extracted(spark, d, V.TIME_PATTERNS)


@query(_extract_sql(V.TEMPORAL_PATTERNS))
def temporal(spark, d):
    return _extracted(spark, d, V.TEMPORAL_PATTERNS)


@query(_extract_sql(V.QUANTITY_PATTERNS))
def quantities(spark, d):
    return _extracted(spark, d, V.QUANTITY_PATTERNS)


@query()
def structured_metadata(spark, d):
    """All nine lists of every text, each whole."""
    m = X.structured_metadata(F.col("text"), None)
    return docs(spark, d).select("doc_id", *[F.array_join(m[k], "|").alias(k) for k in METADATA])


@query()
def entities(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(X.entities(F.col("text")), "|").alias("entities"))


@query("SELECT doc_id, CASE WHEN strlen(text) > 500 THEN left(text, 500) || '...' ELSE text END AS excerpt FROM documents")
def excerpts(spark, d):
    return docs(spark, d).select("doc_id", X.truncate_text(F.col("text")).alias("excerpt"))


# Privacy and consent

_PII_COUNT = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS type, len(regexp_extract_all({_bounded('text') if r'\b' in p else 'text'}, '{_unicode(p)}')) AS n FROM {_ALL}" for k, p in V.PII_PATTERNS.items())


@query(f"SELECT doc_id, type, CAST(n AS BIGINT) AS n FROM ({_PII_COUNT}) WHERE n > 0")
def pii_raw_counts(spark, d):
    c = F.col("text")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("type"), F.regexp_count(c, F.lit("(?U)" + p)).cast("long").alias("n")) for k, p in V.PII_PATTERNS.items()]))
    return docs(spark, d).select("doc_id", each.alias("e")).select("doc_id", "e.*").where("n > 0")


@query()
def pii_spans(spark, d):
    return privacy.detect_pii(docs(spark, d))


@query()
def pii_counts(spark, d):
    return privacy.counts_by_type(docs(spark, d))


@query(f"SELECT d.doc_id, sha256(text) AS restored, coalesce(c.n, 0) > 0 AS masked, false AS mail_left FROM documents d LEFT JOIN (SELECT doc_id, sum(n) AS n FROM ({_PII_COUNT}) GROUP BY 1) c USING (doc_id)")
def pii_round_trip(spark, d):
    """Digests of texts that were masked and restored from masks and tokens alone; whether masking changed them, and left an address."""
    found = privacy.anonymize(docs(spark, d)).join(docs(spark, d).select("doc_id", "text"), "doc_id")
    back = privacy.deanonymize(F.col("masked"), F.col("tokens"))
    return found.select("doc_id", F.sha2(back, 256).alias("restored"), (F.col("masked") != F.col("text")).alias("masked"), F.col("masked").rlike("(?U)" + V.PII_PATTERNS["EMAIL"]).alias("mail_left"))


@query("SELECT doc_id FROM documents d WHERE CASE doc_id % 3 WHEN 0 THEN 'technical' WHEN 1 THEN 'health' ELSE 'general' END IN ('professional', 'technical', 'general')")
def consent_filter(spark, d):
    session = consent.create(consent.empty(spark), "s", "2025-01-01 00:00:00", "professional")
    rows = docs(spark, d).withColumn("category", F.get(F.array(*map(F.lit, ["technical", "health", "general"])), (F.col("doc_id") % 3).cast("int")))
    return consent.permitted(rows, session).select("doc_id")


# Conversations, events, jobs

@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1")
def conversation_docs(spark, d):
    return connectors.captured_documents(t(spark, d, "conversations"))


@query("SELECT conv_id, turn, role, text FROM conversations WHERE role <> 'system' AND text <> ''")
def chat_messages_clean(spark, d):
    return t(spark, d, "conversations").where("role <> 'system' and text <> ''").select("conv_id", "turn", "role", "text")


@query("SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1 ORDER BY n DESC, conv_id LIMIT 20")
def conversation_page(spark, d):
    return t(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "conv_id").limit(20)


@query("SELECT DISTINCT user_id, event_type FROM events")
def capture_dedup(spark, d):
    return t(spark, d, "events").dropDuplicates(["user_id", "event_type"]).select("user_id", "event_type")


@query("""SELECT event_id, CAST(sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM
(SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 3600000000 THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""")
def session_ttl_1h(spark, d):
    return jobs.sessions_by_gap(t(spark, d, "events")).select("event_id", "session")


@query("SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    return streams.event_windows(t(spark, d, "events")).select("event_type", "start", "n", F.round("total", 4).alias("total"))


@query("SELECT count(*) FILTER (k = 0) AS queued, count(*) FILTER (k = 1) AS processing, count(*) FILTER (k = 2) AS completed, count(*) FILTER (k = 3) AS failed FROM (SELECT event_id % 4 AS k FROM events)")
def job_status_pivot(spark, d):
    status = F.get(F.array(*map(F.lit, jobs.STATUSES)), (F.col("event_id") % 4).cast("int"))
    return jobs.status_counts(t(spark, d, "events").select(status.alias("status")))


def _jobs(spark, d) -> DataFrame:
    status = F.get(F.array(*map(F.lit, jobs.STATUSES)), (F.col("event_id") % 4).cast("int"))
    return t(spark, d, "events").select(F.col("event_id").alias("id"), status.alias("status"), F.col("event_id").alias("queued_at"), F.col("event_id").alias("completed_at"))


@query("SELECT event_id AS id FROM events WHERE event_id % 4 < 2 UNION ALL (SELECT event_id FROM events WHERE event_id % 4 >= 2 ORDER BY event_id DESC LIMIT 100)")
def job_clean_up(spark, d):
    return jobs.clean_up(_jobs(spark, d)).select("id")


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def latest_status(spark, d):
    return connectors.latest(t(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id").select("user_id", "event_id")


_KINDS = " ".join(f"WHEN lower(regexp_extract(url, '\\.([^./\\\\]+)$', 1)) IN ({', '.join(repr(e) for e in es)}) THEN '{k}'" for k, es in V.FILE_KINDS.items())


@query(f"SELECT page_id, CASE {_KINDS} ELSE 'unknown' END AS kind FROM pages")
def file_kinds(spark, d):
    return t(spark, d, "pages").select("page_id", X.file_kind(F.col("url")).alias("kind"))


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS types FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL) GROUP BY 1")
def document_topics(spark, d):
    e = t(spark, d, "events").select("user_id", "event_id", F.array("event_type").alias("topics"))
    return X.document_topics(e, "user_id", "event_id").select("user_id", F.array_join("topics", ",").alias("types"))


@query("SELECT count(*) AS total_captures, count(DISTINCT conv_id) AS conversations_tracked FROM conversations")
def capture_stats(spark, d):
    return connectors.capture_stats(t(spark, d, "conversations"))


@query("SELECT label, i, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY 1, 2")
def mean_pool(spark, d):
    return VEC.mean_vectors(t(spark, d, "embeddings"), "label", "embedding").select("label", F.col("i").cast("long").alias("i"), F.round("mean", 6).alias("mean"))


@query("SELECT vec_id, round((CAST(embedding[1] AS DOUBLE) + CAST(embedding[3] AS DOUBLE)) / 2, 6) AS first, round((CAST(embedding[2] AS DOUBLE) + CAST(embedding[4] AS DOUBLE)) / 2, 6) AS second FROM embeddings")
def masked_mean_pool(spark, d):
    """The first and third of three tokens of two dimensions count, the second one is masked."""
    e = F.col("embedding")
    tokens = F.array(F.slice(e, 1, 2), F.slice(e, 5, 2), F.slice(e, 3, 2))
    pooled = VEC.mean_pool(tokens, F.array(F.lit(1), F.lit(0), F.lit(1)))
    return t(spark, d, "embeddings").select("vec_id", F.round(F.get(pooled, 0), 6).alias("first"), F.round(F.get(pooled, 1), 6).alias("second"))


@query("SELECT count(DISTINCT doc_id) + count(DISTINCT source) AS node_count, count(*) AS edge_count FROM documents")
def entity_graph(spark, d):
    mentions = docs(spark, d).select("doc_id", F.array("source").alias("entities"))
    return graph.stats(*graph.from_entities(mentions))


@query("SELECT page_id, replace(url, 'http://', 'file:/') AS path FROM pages WHERE starts_with(url, 'http://') UNION ALL SELECT page_id, url FROM pages WHERE NOT starts_with(url, 'http://')")
def manifest_rewrite(spark, d):
    return connectors.rewrite_paths(t(spark, d, "pages").select("page_id", F.col("url").alias("path")), "http://", "file:/")


@query("SELECT event_id, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events) WHERE k = (SELECT min(x) FROM (SELECT unnest(json_keys(props)) AS x FROM events))")
def metadata_values(spark, d):
    e = t(spark, d, "events").select("event_id", X.metadata_map(F.col("props")).alias("m"))
    pairs = e.select("event_id", F.explode("m").alias("k", "value"))
    first = pairs.agg(F.min("k").alias("k"))
    return pairs.join(F.broadcast(first), "k").select("event_id", "value")


# Generic joins and aggregates over the star schema

@query("SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def orders_by_nation(spark, d):
    o, c, n = t(spark, d, "orders"), t(spark, d, "customer"), t(spark, d, "nation")
    return o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders))")
def customers_without_large_orders(spark, d):
    o = t(spark, d, "orders")
    large = o.join(F.broadcast(o.agg((F.avg("o_totalprice") * 1.5).alias("_least"))), F.col("o_totalprice") > F.col("_least"))  # a table of one row
    return t(spark, d, "customer").join(large.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY l_extendedprice DESC, l_linenumber) = 1")
def best_line_per_order(spark, d):
    o, l = t(spark, d, "orders").select("o_orderkey"), t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")  # noqa: E741
    w = Window.partitionBy("o_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber")
    return o.join(l, o.o_orderkey == l.l_orderkey).withColumn("r", F.row_number().over(w)).where("r = 1").select("o_orderkey", "l_linenumber")
