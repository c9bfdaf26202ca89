"""Keyword, vector and hybrid search.

The index (``keyword_index``) is a written postings table with one row for each term
and chunk, next to the chunk's length, in folders by bucket of terms. A query is a small
set of terms, so it opens their buckets only and joins nothing but what was deleted
since, and every result list ends in a top-k that each partition cuts by itself first.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, OrderedDict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalore.functions import porter
from stratalore.functions.text import passage, truncate_text
from stratalore.functions.vectors import cosine_to, dequantize
from stratalore.functions.vocabulary import PROMPT_HEAD, PROMPT_PLAIN, PROMPT_TAIL
from stratalore.operators.keyword_index import KeywordIndex
from stratalore.session import files_state, parquet_scan, scan_roots

K1, B, IDF_FLOOR, RRF_K, BOOST = 1.2, 0.75, 1e-6, 60, 0.15


def plain_tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def word_tokens(text: Column) -> Column:
    """Runs of letters and digits of any script, lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\p{M}\p{Co}]+"), lambda t: t != "")


#: Words whose stems a worker remembers.
MEMO_WORDS = 200_000
_stems: dict[str, str] = {}


def stem_words(words) -> list[str]:
    """Folded Porter stems; each word is stemmed once while it is remembered."""
    if len(_stems) > MEMO_WORDS:
        _stems.clear()
    for w in words:
        if w not in _stems:
            _stems[w] = porter.stem(fold(w))
    return [_stems[w] for w in words]


def build_index(chunks: DataFrame, stemmed: bool = True, id_col: str = "chunk_id", text_cols: tuple[str, ...] = ("text",), level_col: str | None = None, path: str | None = None) -> KeywordIndex:
    """Write the index of all chunks below ``path`` (by default a new shared folder); each text is cut into words once."""
    return KeywordIndex.create(chunks, stemmed, id_col, text_cols, level_col, path)


#: Tables whose indexes are remembered; the one used longest ago is forgotten first.
REMEMBERED = 32
_indexes: OrderedDict[tuple, tuple[int, KeywordIndex]] = OrderedDict()


def shared_index(chunks: DataFrame, stemmed: bool = True, id_col: str = "chunk_id", text_cols: tuple[str, ...] = ("text",), level_col: str | None = None) -> KeywordIndex:
    """The index of a table in Parquet files: built once, and brought up to date by its changed rows when its files change; of any other plan a new one."""
    options = (stemmed, id_col, text_cols, level_col)
    if not parquet_scan(chunks):
        return build_index(chunks, *options)
    key = (chunks.sparkSession.sparkContext.applicationId, scan_roots(chunks), *options)
    state, known = files_state(chunks), _indexes.get(key)
    if known is None:
        _indexes[key] = state, build_index(chunks, *options)
    elif known[0] != state:
        _indexes[key] = state, known[1].sync(chunks)
    _indexes.move_to_end(key)
    while len(_indexes) > REMEMBERED:
        _indexes.popitem(last=False)
    return _indexes[key][1]


def query_phrases(query: str, stemmed: bool = True) -> dict[tuple[str, ...], int]:
    """Phrases of a query with their number of times; quotes are ignored, marks alone match nothing."""
    out: Counter = Counter()
    for token in query.split():
        parts = re.findall(r"[^\W_]+" if stemmed else "[a-z0-9]+", (fold(token) if stemmed else token.lower()).replace('"', ""))
        phrase = tuple(porter.stem(p) if stemmed else p for p in parts)
        if phrase:
            out[phrase] += 1
    return dict(out)


def _phrase_hits(postings: DataFrame, phrase: tuple[str, ...]) -> DataFrame:
    """(chunk_id, level, length, tf) of a phrase: the positions of its words, each moved back by its place, meet."""
    starts = postings.where(F.col("term").isin(list(phrase))).groupBy("chunk_id", "level", "length").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))

    def moved_back(k: int) -> Column:
        return F.transform(F.element_at("at", F.lit(phrase[k])), lambda p: p - k)

    moved = [moved_back(k) for k in range(len(phrase))]
    both = moved[0]
    for m in moved[1:]:
        both = F.array_intersect(both, m)
    return starts.where(F.size("at") == len(set(phrase))).select("chunk_id", "level", "length", F.size(both).cast("long").alias("tf")).where("tf > 0")


def bm25(index: KeywordIndex, query: str, top_k: int | None = 10, level: int | None = None) -> DataFrame:
    """(chunk_id, score) by BM25, best first; statistics are over all chunks, the level is filtered after.

    The postings of the query's words are read twice: for the number of chunks of
    each phrase, which becomes a constant, and for the scores.
    """
    phrases = query_phrases(query, index.stemmed)
    if not phrases or not index.chunks:
        return index.postings.limit(0).select("chunk_id", F.lit(0.0).alias("score"))
    postings = index.of(sorted({w for p in phrases for w in p}))
    single = [p[0] for p in phrases if len(p) == 1]
    columns = ["chunk_id", "level", "length", "tf"]
    hits = postings.where(F.col("term").isin(single)).select(*columns, F.col("term").alias("phrase"))
    for phrase in (p for p in phrases if len(p) > 1):
        hits = hits.unionByName(_phrase_hits(postings, phrase).withColumn("phrase", F.lit(" ".join(phrase))))
    weight = F.lit(0.0)
    for r in hits.groupBy("phrase").agg(F.count("*").alias("df")).collect():
        idf = math.log((index.chunks - r.df + 0.5) / (r.df + 0.5))
        weight = F.when(F.col("phrase") == r.phrase, (idf if idf > 0 else IDF_FLOOR) * phrases[tuple(r.phrase.split(" "))]).otherwise(weight)
    if level is not None:
        hits = hits.where(F.col("level") == level)
    part = weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / (index.average or 1.0)))
    scored = hits.groupBy("chunk_id").agg(F.sum(part).alias("score"))
    return scored.orderBy(F.desc("score"), "chunk_id").limit(top_k) if top_k else scored


def vector_search(vectors: DataFrame, query: list[float], top_k: int | None = 10, id_col: str = "chunk_id", vector_col: str = "vector") -> DataFrame:
    """(chunk_id, score) by cosine, best first; a query of no length finds nothing."""
    if math.sqrt(sum(x * x for x in query)) < 1e-9:
        return vectors.limit(0).select(F.col(id_col).alias("chunk_id"), F.lit(0.0).alias("score"))
    scored = vectors.select(F.col(id_col).alias("chunk_id"), F.coalesce(cosine_to(F.col(vector_col), query), F.lit(0.0)).alias("score"))
    return scored.orderBy(F.desc("score"), "chunk_id").limit(top_k) if top_k else scored


def decoded(embeddings: DataFrame) -> DataFrame:
    """(chunk_id, vector) of quantized embeddings."""
    return embeddings.select("chunk_id", dequantize(F.col("codes"), F.col("scale"), F.col("offset")).alias("vector"))


def fuse(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (chunk_id, score) lists that are already cut to their best rows."""
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id"))
    ranked = [x.select("chunk_id", (1.0 / (k + rank)).alias("part")) for x in lists]
    both = ranked[0]
    for r in ranked[1:]:
        both = both.unionByName(r)
    return both.groupBy("chunk_id").agg(F.sum("part").alias("score")).orderBy(F.desc("score"), "chunk_id")


def hybrid_search(index: KeywordIndex, vectors: DataFrame | None, query: str, query_vector: list[float] | None, bm25_k: int = 20, vector_k: int = 20, rrf_k: int = RRF_K) -> DataFrame:
    """Fused keyword and vector results; keyword results alone without vectors."""
    words = bm25(index, query, bm25_k, 1)
    if vectors is None or query_vector is None:
        return words
    return fuse([words, vector_search(vectors, query_vector, vector_k)], rrf_k)


def entity_boost(hits: DataFrame, query: str, text_col: str = "enriched_text") -> DataFrame:
    """Adds a flat amount to hits whose enriched text has a query term of over two bytes."""
    terms = [t for t in query.lower().split() if len(t.encode()) > 2]
    low = F.lower(F.col(text_col))
    found = F.lit(False)
    for t in terms:
        found = found | F.coalesce(low.contains(t), F.lit(False))
    return hits.withColumn("score", F.when(found, F.col("score") + BOOST).otherwise(F.col("score")))


def entity_rank(hits: DataFrame, query: str, text_col: str = "text") -> DataFrame:
    """Adds an amount by the share of query terms in the text."""
    terms = query.lower().split()
    low = F.lower(F.col(text_col))
    n = F.lit(0)
    for t in terms:
        n = n + F.coalesce(low.contains(t).cast("int"), F.lit(0))
    return hits.withColumn("score", F.col("score") + BOOST * n / max(1, len(terms))) if terms else hits


def best_per_document(hits: DataFrame, top_k: int | None, doc_col: str = "doc_id") -> DataFrame:
    """The best hit of each document, the best first; all documents if ``top_k`` is None."""
    rank = F.row_number().over(Window.partitionBy(doc_col).orderBy(F.desc("score"), "chunk_id"))
    best = hits.withColumn("_rank", rank).where("_rank = 1").drop("_rank").orderBy(F.desc("score"), "chunk_id")
    return best if top_k is None else best.limit(top_k)


def search(index: KeywordIndex, chunks: DataFrame, vectors: DataFrame | None, query: str, query_vector: list[float] | None = None, top_k: int = 10) -> DataFrame:
    """Twice the hits from either branch, fused, boosted, one for each document."""
    hits = hybrid_search(index, vectors, query, query_vector, 2 * top_k, 2 * top_k)
    return best_per_document(entity_boost(chunks.join(F.broadcast(hits), "chunk_id"), query), top_k)


def enhanced_search(index: KeywordIndex, chunks: DataFrame, vectors: DataFrame | None, query: str, query_vector: list[float] | None = None, top_k: int = 10) -> DataFrame:
    """Search results with a passage and the parent's text."""
    hits = search(index, chunks, vectors, query, query_vector, top_k)
    up = chunks.select(F.col("chunk_id").alias("_pid"), F.col("text").alias("parent_context"))
    out = hits.withColumn("passage", passage(F.col("text"), query)).join(up, F.col("parent_chunk_id") == F.col("_pid"), "left").drop("_pid")
    return out.orderBy(F.desc("score"), "chunk_id")


def search_with_topic(index: KeywordIndex, chunks: DataFrame, vectors: DataFrame | None, query: str, topic: str, query_vector: list[float] | None = None, top_k: int = 10) -> DataFrame:
    """Three times the hits, those with the topic kept."""
    hits = hybrid_search(index, vectors, query, query_vector, 3 * top_k, 3 * top_k)
    return chunks.join(F.broadcast(hits), "chunk_id").where(F.array_contains("topics", topic)).orderBy(F.desc("score"), "chunk_id").limit(top_k)


def rag_context(hits: DataFrame, min_score: float = 0.01, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(chunk_id, excerpt, score, source) of hits over the least score."""
    return hits.where(F.col("score") >= min_score).select("chunk_id", truncate_text(F.col(text_col)).alias("excerpt"), "score", F.col(source_col).alias("source"))


def rag_prompt(context: DataFrame) -> DataFrame:
    """One row: the system prompt with numbered excerpts, best first. The context is a top-k result."""
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id"))
    line = F.concat(F.lit("["), rank.cast("string"), F.lit("]"), F.when(F.col("source").isNotNull(), F.concat(F.lit(" (source: "), F.col("source"), F.lit(")"))).otherwise(""), F.lit(": "), F.col("excerpt"))
    lines = context.select(rank.alias("rank"), line.alias("line")).agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("all"))
    joined = F.array_join(F.transform("all", lambda s: s["line"]), "\n\n")
    return lines.select(F.when(F.size("all") == 0, F.lit(PROMPT_PLAIN)).otherwise(F.concat(F.lit(PROMPT_HEAD), joined, F.lit(PROMPT_TAIL))).alias("prompt"))


def chat_messages(context: DataFrame, history: DataFrame, message: str, order: str = "turn") -> DataFrame:
    """(place, role, content) of a request: the system prompt with its context, the talk so far (role, content) in order, the new message.

    The history is one conversation's; its places follow its order.
    """
    system = rag_prompt(context).select(F.lit(0).alias("place"), F.lit("system").alias("role"), F.col("prompt").alias("content"))
    talk = history.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), "role", "content"))).alias("all"), (F.count("*") + 1).cast("int").alias("last"))
    said = talk.select(F.posexplode("all").alias("k", "m")).select((F.col("k") + 1).alias("place"), "m.role", "m.content")
    new = talk.select(F.col("last").alias("place"), F.lit("user").alias("role"), F.lit(message).alias("content"))
    return system.unionByName(said).unionByName(new)
