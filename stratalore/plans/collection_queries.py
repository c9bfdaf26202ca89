"""Queries of the verbs, the store, exports and streams over the driver's tables, and their SQL.

``documents`` stands in for chunks of a collection: its id is the chunk's, its
source the document's, the document before it the parent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from stratalore.functions import text as X
from stratalore.functions import vectors as VEC
from stratalore.operators import consolidate as CO
from stratalore.operators import jobs, search
from stratalore.operators import store as S
from stratalore.plans import verbs
from stratalore.plans.queries import _BM25, _COS, _TOPICS, WORDS, _vector, docs, query, t
from stratalore.session import fresh_path, materialize
from stratalore.sources import archives, connectors, files
from stratalore.streaming import ingest as streams
from stratalore.streaming import keyed_state

# Search


def _fused(k: int) -> str:
    return f"""WITH {_BM25}, {_COS},
a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM bm QUALIFY r <= {k}),
b AS (SELECT vec_id AS id, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM cos QUALIFY r <= {k}),
f AS (SELECT id, sum(1.0 / (60 + r)) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id)"""


_BOOST = "CASE WHEN contains(lower(d.text), 'the') OR contains(lower(d.text), 'nicht') THEN 0.15 ELSE 0 END"
_HITS = f"{_fused(20)}, h AS (SELECT id, d.source, d.text, score + {_BOOST} AS s FROM f JOIN documents d ON d.doc_id = id), best AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY source ORDER BY s DESC, id) = 1 ORDER BY s DESC, id LIMIT 10)"


def _search_parts(spark, d):
    chunks = docs(spark, d).select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), "text", F.col("text").alias("enriched_text"), (F.col("doc_id") - 1).alias("parent_chunk_id"), F.array("lang").alias("topics"))
    vectors = t(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    return search.shared_index(docs(spark, d), False, "doc_id"), chunks, vectors, WORDS


@query(f"{_HITS} SELECT id AS doc_id, source, round(s, 6) AS score FROM best")
def search_documents(spark, d):
    return search.search(*_search_parts(spark, d), _vector(spark, d), 10).select(F.col("chunk_id").alias("doc_id"), F.col("doc_id").alias("source"), F.round("score", 6).alias("score"))


@query(f"""{_HITS}, p AS (SELECT best.*, coalesce(nullif(strpos(lower(text), 'the'), 0) - 1, nullif(strpos(lower(text), 'nicht'), 0) - 1, 0) AS pos, length(text) AS n FROM best),
e AS (SELECT *, greatest(pos - 200, 0) AS l, least(pos + 200, n) AS r FROM p),
w AS (SELECT *, CASE WHEN contains(left(text, l), ' ') THEN l - strpos(reverse(left(text, l)), ' ') + 1 ELSE l END AS b, CASE WHEN strpos(substr(text, r + 1), ' ') > 0 THEN r + strpos(substr(text, r + 1), ' ') - 1 ELSE r END AS z FROM e)
SELECT id AS doc_id, round(s, 6) AS score, CASE WHEN b > 0 THEN '...' ELSE '' END || substr(w.text, b + 1, z - b) || CASE WHEN z < n THEN '...' ELSE '' END AS passage, sha256(u.text) AS parent FROM w LEFT JOIN documents u ON u.doc_id = id - 1""")
def enhanced_search(spark, d):
    hits = search.enhanced_search(*_search_parts(spark, d), _vector(spark, d), 10)
    return hits.select(F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"), "passage", F.sha2("parent_context", 256).alias("parent"))


@query(f"{_fused(30)} SELECT id AS doc_id, round(score, 6) AS score FROM f JOIN documents d ON d.doc_id = id WHERE d.lang = 'de' ORDER BY f.score DESC, id LIMIT 10")
def search_with_topic(spark, d):
    index, chunks, vectors, words = _search_parts(spark, d)
    return search.search_with_topic(index, chunks, vectors, words, "de", _vector(spark, d), 10).select(F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"WITH {_BM25} SELECT d.doc_id, round(score, 6) AS score FROM bm JOIN documents d USING (doc_id) ORDER BY bm.score DESC, d.doc_id LIMIT 10 OFFSET 0".replace("SELECT d.doc_id, round", "SELECT d.doc_id, d.lang, round"))
def hit_chunks(spark, d):
    """Hits with a column of their chunk, fetched for the hits alone."""
    index, chunks, _, words = _search_parts(spark, d)
    hits = chunks.join(F.broadcast(search.bm25(index, words, 10, 1)), "chunk_id")
    return hits.select(F.col("chunk_id").alias("doc_id"), F.get("topics", 0).alias("lang"), F.round("score", 6).alias("score"))


def _store(spark, d) -> S.Store:
    """A collection of the table's rows, each a document with one chunk; no index is made."""
    rows = docs(spark, d)
    documents = rows.select(F.col("doc_id").alias("id"), "text", F.create_map(F.lit("source"), F.col("source"), F.lit("topics"), F.concat_ws(",", F.lit("x"), "lang")).alias("metadata"), F.lit("").alias("content_hash"), F.col("doc_id").alias("created_at"), F.lit(None).cast("long").alias("updated_at"))
    chunks = rows.select(F.col("doc_id").alias("id"), "doc_id", F.lit(None).cast("long").alias("parent_chunk_id"), "text", F.lit(None).cast("string").alias("enriched_text"), F.lit(0).alias("chunk_index"), F.lit(0).alias("char_start"), F.lit(0).alias("char_end"), F.lit(1).alias("level"), F.col("doc_id").alias("created_at"))
    return S.Store(documents, chunks, S.empty(spark, S.EMBEDDINGS))


def _recall(spark, d) -> verbs.Recall:
    return verbs.Recall(_store(spark, d), search.shared_index(docs(spark, d), False, "doc_id"))


_TOP = f"WITH {_BM25}, top AS (SELECT bm.doc_id, score, d.source, d.lang, d.text FROM bm JOIN documents d USING (doc_id) ORDER BY score DESC, bm.doc_id LIMIT 50)"


@query(f"{_TOP} SELECT doc_id, round(score, 6) AS score FROM top WHERE source IN ('src1') AND doc_id >= 5")
def recall_by_source_and_date(spark, d):
    out, _ = _recall(spark, d).resolve(verbs.Query(WORDS, "keyword", 50, source="src1", since=5))
    return out.select("doc_id", F.round("score", 6).alias("score"))


@query(f"{_TOP} SELECT doc_id, round(score, 6) AS score FROM top WHERE lang = 'de'")
def recall_by_topic(spark, d):
    out, _ = _recall(spark, d).resolve(verbs.Query(WORDS, "keyword", 50, topic="de"))
    return out.select("doc_id", F.round("score", 6).alias("score"))


@query(f"{_TOP} SELECT doc_id, round(score + 0.15 * (CAST(contains(lower(text), 'nicht') AS INT) + CAST(contains(lower(text), 'the') AS INT)) / 2.0, 6) AS score FROM top")
def recall_entities(spark, d):
    out, _ = _recall(spark, d).resolve(verbs.Query(WORDS, "entity", 50))
    return out.select("doc_id", F.round("score", 6).alias("score"))


@query(f"{_TOP} SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id DESC) AS INT) AS place FROM top")
def recall_timeline(spark, d):
    out, _ = _recall(spark, d).resolve(verbs.Query(WORDS, "timeline", 50))
    ordered = out.agg(F.collect_list("doc_id").alias("ids"))  # at most 50 rows
    return ordered.select(F.posexplode("ids").alias("place", "doc_id")).select("doc_id", (F.col("place") + 1).alias("place"))


# Ingest, distill, consolidate


@query("""SELECT (SELECT count(DISTINCT text) FROM documents) AS documents, (SELECT count(*) - count(DISTINCT text) FROM documents) AS duplicates, (SELECT count(DISTINCT text) FROM documents WHERE strlen(text) <= 3000) AS whole_chunks,
(SELECT CAST(sum(strlen(regexp_replace(text, '[^A-Za-z0-9]', '', 'g'))) AS BIGINT) FROM (SELECT DISTINCT text FROM documents)) AS letters""")
def ingest_documents(spark, d):
    """Documents and chunks of a collection filled from the table; no letter is lost or doubled by cutting."""
    incoming = docs(spark, d).select("text", F.create_map(F.lit("source"), F.col("source")).alias("metadata"))
    store, tally = verbs.ingest(S.Store.create(spark), incoming)
    chunks = materialize(store.chunks, "ingested")
    got = chunks.where("level = 1").agg(F.count_if(F.col("parent_chunk_id").isNull()).alias("whole_chunks"), F.sum(F.octet_length(F.regexp_replace("text", "[^A-Za-z0-9]", ""))).alias("letters"))
    return tally.select(F.col("added").alias("documents"), "duplicates").crossJoin(got)  # two one-row tables


@query("SELECT doc_id, sha256(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) AS digest FROM documents")
def chunk_letters(spark, d):
    """The letters of each document, put together again from its chunks in order."""
    from stratalore.functions.chunking import chunk_documents

    lines = chunk_documents(docs(spark, d)).where("level = 1").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("all"))
    whole = F.array_join(F.transform("all", lambda c: c["text"]), "")
    return lines.select("doc_id", F.sha2(F.regexp_replace(whole, "[^A-Za-z0-9]", ""), 256).alias("digest"))


@query(f"""WITH {_TOPICS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, topic) AS i FROM tc QUALIFY i <= 3), l AS (SELECT doc_id, string_agg(topic, ' ' ORDER BY i) AS ts FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(ts, 'general') AS topics, CAST(64 AS INT) AS dim, CAST((SELECT count(*) FROM documents) AS BIGINT) AS enriched, CAST((SELECT count(*) FROM documents) AS BIGINT) AS embedded FROM documents d LEFT JOIN l USING (doc_id)""")
def distill_documents(spark, d):
    """Topics that lead the enriched text, and the size of the vector, of every chunk that had neither."""
    store, counts = verbs.distill(_store(spark, d), verbs.HashingEmbedder(64))
    chunks = store.chunks.select("id", F.regexp_extract("enriched_text", "^topics: ([a-z ]+?)(?: \\| |$)", 1).alias("topics"))
    out = chunks.join(store.embeddings.select(F.col("chunk_id").alias("id"), F.size("codes").alias("dim")), "id", "left")
    n = counts.first()  # two numbers, before the texts and not as a job among theirs
    return out.select(F.col("id").alias("doc_id"), "topics", "dim", F.lit(n.enriched).cast("long").alias("enriched"), F.lit(n.embedded).cast("long").alias("embedded"))


@query("""WITH u AS (SELECT max(doc_id) AS id FROM documents GROUP BY text), k AS (SELECT id FROM u ORDER BY id DESC LIMIT 1000),
c AS (SELECT doc_id AS id FROM labels) SELECT k.id AS doc_id, (SELECT count(*) FROM c WHERE id NOT IN (SELECT doc_id FROM documents)) AS orphans_removed, (SELECT count(*) FROM documents) - (SELECT count(*) FROM u) AS duplicates_removed, greatest(0, (SELECT count(*) FROM u) - 1000) AS evicted FROM k""")
def consolidate_documents(spark, d):
    """What a collection of the smallest tier keeps, with the report of what went; chunks are the labelled ids."""
    rows = docs(spark, d)
    documents = rows.select(F.col("doc_id").alias("id"), "text", F.create_map().cast("map<string,string>").alias("metadata"), X.content_hash(F.col("text")).alias("content_hash"), F.col("doc_id").alias("created_at"), F.lit(None).cast("long").alias("updated_at"))
    chunks = t(spark, d, "labels").select(F.col("doc_id").alias("id"), "doc_id").withColumns({c.split()[0]: F.lit(None).cast(c.split()[1]) for c in S.CHUNKS.split(", ")[2:]})
    kept, report = CO.consolidate(S.Store(documents, chunks, S.empty(spark, S.EMBEDDINGS)), "base")
    return kept.documents.select(F.col("id").alias("doc_id")).crossJoin(F.broadcast(report))  # one row of counts


# Store


@query("SELECT doc_id, d.source, l.doc_id IS NOT NULL AS enriched FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l USING (doc_id)")
def set_enriched_text(spark, d):
    chunks = docs(spark, d).select(F.col("doc_id").alias("id"), "source", F.lit(None).cast("string").alias("enriched_text"))
    changes = t(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id"), F.lit("good").alias("enriched_text")).distinct()
    return S.set_enriched_text(chunks, changes).select(F.col("id").alias("doc_id"), "source", F.col("enriched_text").isNotNull().alias("enriched"))


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 50")
def pending_enrichment(spark, d):
    """The oldest batch of fifty chunks to enrich."""
    return S.lacking_enrichment(_store(spark, d).chunks, 50).select("doc_id")


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 0.0 ELSE round(list_min(CAST(embedding AS DOUBLE[])), 6) END AS \"offset\" FROM embeddings")
def upsert_embeddings(spark, d):
    q = t(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), VEC.quantize(F.col("embedding")).alias("q")).select("chunk_id", "q.codes", "q.scale", "q.offset")
    changes = q.where("chunk_id % 3 = 0").withColumn("offset", F.lit(0.0))
    return S.upsert_embeddings(q, changes).select(F.col("chunk_id").alias("vec_id"), F.round("offset", 6).alias("offset"))


@query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM conversations) AS chunks, (SELECT count(*) FROM conversations WHERE turn = 0) AS sections, (SELECT count(*) FROM conversations WHERE turn = 1) AS paragraphs, (SELECT count(*) FROM conversations WHERE role = 'user') AS enriched, (SELECT count(*) FROM embeddings) AS embeddings, (SELECT CAST(max(len(embedding)) AS INT) FROM embeddings) AS dim")
def store_stats(spark, d):
    chunks = t(spark, d, "conversations").select(F.col("turn").alias("level"), F.when(F.col("role") == "user", "x").alias("enriched_text"))
    return S.stats(S.Store(docs(spark, d), chunks, t(spark, d, "embeddings").select(F.col("embedding").alias("codes"))))


@query("SELECT conv_id, turn FROM conversations WHERE conv_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def orphans_pruned(spark, d):
    """Chunks that stay where their documents are the ones labelled good."""
    documents = t(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id")).distinct()
    chunks = t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.concat_ws(":", "conv_id", "turn").alias("id"), "turn")
    return S.prune_orphans(S.Store(documents, chunks, chunks.select(F.col("id").alias("chunk_id")))).chunks.select(F.col("doc_id").alias("conv_id"), "turn")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def delete_documents(spark, d):
    store = _store(spark, d)
    gone = t(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias("id"))
    return S.delete_documents(store, gone).chunks.select("doc_id")


@query("SELECT 3 AS doc_id, string_agg(text, '|' ORDER BY turn) AS chunks FROM conversations WHERE conv_id = 3")
def document_detail(spark, d):
    chunks = t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), F.lit(1).alias("level"), "text")
    got = S.document_with_chunks(S.Store(docs(spark, d).select(F.col("doc_id").alias("id")), chunks, chunks), 3)
    return got.select(F.col("id").cast("int").alias("doc_id"), F.array_join(F.transform("chunks", lambda c: c["text"]), "|").alias("chunks"))


@query("SELECT CAST(row_number() OVER (ORDER BY user_id, event_id) AS BIGINT) + 99 AS id, event_id FROM events")
def ids_in_order(spark, d):
    return S.with_ids(t(spark, d, "events").select("user_id", "event_id"), 100, ["user_id", "event_id"]).select("id", "event_id")


@query("SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN 'queued' WHEN event_id % 5 = 1 THEN 'failed' ELSE 'completed' END AS status, CASE event_id % 5 WHEN 1 THEN 'broken file' WHEN 2 THEN 'Duplicate document' END AS error FROM events")
def job_outcomes(spark, d):
    e = t(spark, d, "events").select(F.col("event_id").alias("id"))
    rows = e.select("id", F.lit("queued").alias("status"), F.lit(None).cast("long").alias("document_id"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("long").alias("completed_at"))
    kind = F.col("id") % 5
    results = e.where(kind != 0).select("id", F.when(kind > 2, F.col("id")).alias("document_id"), F.when(kind == 1, "broken file").when(kind == 2, "Duplicate document").alias("error"))
    return jobs.outcome(rows, results, 7).select("id", "status", "error")


# Names, media, cookies, providers


@query("SELECT doc_id, left(regexp_replace(text, '[^\\p{L}\\p{N} \\-]', '_', 'g'), 50) AS title FROM documents")
def safe_titles(spark, d):
    return docs(spark, d).select("doc_id", X.safe_title(F.col("text")).alias("title"))


@query("SELECT page_id, replace(replace(replace(url, '/', ''), '\\', ''), '..', '') AS name FROM pages")
def sanitized_names(spark, d):
    return t(spark, d, "pages").select("page_id", X.sanitize_filename(F.col("url")).alias("name"))


@query("SELECT event_id, left(sha256(event_type || CAST(user_id AS VARCHAR)), 32) AS device, greatest(0.5, least(24.0, value / 10)) AS hours FROM events".replace("0.5", "CAST(0.5 AS DOUBLE)").replace("24.0", "CAST(24 AS DOUBLE)"))
def devices_and_intervals(spark, d):
    return t(spark, d, "events").select("event_id", connectors.device_fingerprint(F.col("event_type"), F.col("user_id").cast("string")).alias("device"), connectors.interval_hours(F.col("value") / 10).alias("hours"))


_ENDINGS = ["JPG", "webm", "flac", "txt"]
_MEDIA = f"SELECT doc_id, ([{', '.join(map(repr, _ENDINGS))}])[1 + doc_id % 4] AS ext, strlen(text) AS size FROM documents"


def _entries(spark, d) -> DataFrame:
    ending = F.get(F.array(*map(F.lit, _ENDINGS)), (F.col("doc_id") % 4).cast("int"))
    return docs(spark, d).select(F.lit("export.zip").alias("path"), F.concat(F.lit("media/"), F.col("doc_id"), F.lit("."), ending).alias("entry"), F.octet_length("text").cast("long").alias("size"))


@query(f"SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER (ext = 'JPG') AS photos, count(*) FILTER (ext = 'webm') AS videos, count(*) FILTER (ext = 'flac') AS audios FROM ({_MEDIA}) WHERE ext <> 'txt'")
def media_totals(spark, d):
    return connectors.media_totals(connectors.media_registry(_entries(spark, d)))


_COOKIES = "SELECT event_id, ([ 'x.chatgpt.com', '.openai.com', 'a.claude.ai', 'mail.google.com', 'example.org' ])[1 + event_id % 5] AS domain FROM events"


def _cookies(spark, d) -> DataFrame:
    domains = F.array(*map(F.lit, ["x.chatgpt.com", ".openai.com", "a.claude.ai", "mail.google.com", "example.org"]))
    return t(spark, d, "events").select("event_id", F.get(domains, (F.col("event_id") % 5).cast("int")).alias("domain"))


_SITES = " ".join(f"WHEN {' OR '.join(f'ends_with(domain, {e!r})' for e in ends)} THEN '{name}'" for name, _, ends in connectors.SITES)


@query(f"SELECT CASE {_SITES} END AS site, count(*) AS n FROM ({_COOKIES}) GROUP BY 1 HAVING site IS NOT NULL")
def cookie_counts(spark, d):
    return connectors.cookie_counts(_cookies(spark, d))


@query(f"SELECT event_id FROM ({_COOKIES}) WHERE ends_with(domain, '.openai.com') OR ends_with(domain, '.chatgpt.com')")
def cookies_of_site(spark, d):
    return connectors.cookies_of(_cookies(spark, d), [".chatgpt.com", ".openai.com"]).select("event_id")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'groq' WHEN 1 THEN 'openai' WHEN 2 THEN 'openai' END AS provider FROM events")
def provider_choice(spark, d):
    kind = F.col("event_id") % 4
    preferred = F.when(kind == 0, "auto").when(kind == 1, "openai").when(kind == 2, "auto").otherwise("anthropic")
    keys = F.when(kind == 0, F.create_map(F.lit("openai"), F.lit("k"), F.lit("groq"), F.lit("k"))).otherwise(F.create_map(F.lit("openai"), F.lit("k")))
    return t(spark, d, "events").select("event_id", connectors.provider(preferred, keys).alias("provider"))


@query("SELECT page_id FROM pages WHERE page_id % 2 = 1 OR page_id % 6 = 0")
def new_files(spark, d):
    """Files that a manifest of every second page does not have, or has in an older state."""
    now = t(spark, d, "pages").select("page_id", F.col("url").alias("path"), F.concat_ws(":", "page_id", "url").alias("modified"))
    known = now.where("page_id % 2 = 0").withColumn("modified", F.when(F.col("page_id") % 6 == 0, "old").otherwise(F.col("modified")))
    return files.new_files(now, known).select("page_id")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN sha256(text) WHEN 1 THEN sha256(text) WHEN 2 THEN sha256('# ' || doc_id || chr(10) || chr(10) || '[user]: ' || text) END AS digest FROM documents")
def file_texts(spark, d):
    """Texts out of files: plain, of no known kind, a chat export, and a PDF, which has none."""
    chat = F.to_json(F.array(F.struct(F.col("doc_id").cast("string").alias("title"), F.create_map(F.lit("a"), F.struct(F.struct(F.struct(F.lit("user").alias("role")).alias("author"), F.struct(F.array("text").alias("parts")).alias("content")).alias("message"))).alias("mapping"))))
    kind = (F.col("doc_id") % 4).cast("int")
    path = F.concat(F.col("doc_id"), F.get(F.array(*map(F.lit, [".txt", ".bin", ".json", ".pdf"])), kind))
    rows = docs(spark, d).select(path.alias("path"), F.when(kind == 2, chat).otherwise(F.col("text")).cast("binary").alias("content"))
    return files.extract_text(rows).select(F.regexp_extract("path", r"^\d+", 0).cast("long").alias("doc_id"), F.sha2("text", 256).alias("digest"))


# Exports


def _archived(spark, rows: DataFrame, columns: list[str]) -> DataFrame:
    """(entry, content) rows written as archives, one for each partition of a shuffle, and read back, each archive by several tasks."""
    path = fresh_path(spark, "archives")
    archives.write_zip(rows.repartition("entry"), path)
    return archives.read_zip(spark, path, columns, split=256 << 10)


_CLEAN = "role <> 'system' AND text <> ''"


@query(f"SELECT conv_id, CAST(count(*) AS INT) AS messages, sha256(string_agg(CASE WHEN role IN ('user', 'assistant') THEN role ELSE 'unknown' END || ': ' || text, chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations WHERE {_CLEAN} GROUP BY 1")
def chat_exports(spark, d):
    """Conversations written as chat exports in ZIP archives and read back as documents."""
    message = F.struct(F.struct(F.col("role")).alias("author"), F.struct(F.array("text").alias("parts")).alias("content"), (F.col("turn") + 1).cast("double").alias("create_time"))
    node = F.struct(F.concat(F.lit("n"), F.col("turn")).alias("k"), F.struct(message.alias("message")).alias("v"))
    convs = t(spark, d, "conversations").groupBy("conv_id").agg(F.map_from_entries(F.collect_list(node)).alias("mapping"))
    text = F.to_json(F.array(F.struct(F.col("conv_id").cast("string").alias("id"), F.concat(F.lit("Chat "), F.col("conv_id")).alias("title"), "mapping")))
    rows = convs.select(F.concat(F.lit("export-"), F.col("conv_id"), F.lit("/conversations.json")).alias("entry"), text.alias("content"))
    other = convs.select(F.concat(F.lit("export-"), F.col("conv_id"), F.lit("/user.json")).alias("entry"), F.lit("{}").alias("content"))
    found = connectors.chatgpt_conversations(_archived(spark, rows.unionByName(other), ["entry", "content"]))
    sizes = found.select("id", F.size("messages").alias("messages"))
    texts = connectors.conversation_documents(found).select(F.element_at("metadata", "conversationId").alias("id"), F.sha2("text", 256).alias("digest"))
    return sizes.join(texts, "id").select(F.col("id").cast("long").alias("conv_id"), "messages", "digest")


@query("SELECT 'post' AS type, doc_id AS timestamp, text FROM documents WHERE text <> '' UNION ALL SELECT 'comment', doc_id, text FROM documents WHERE text <> ''")
def social_posts(spark, d):
    """Posts and comments of a social export, every document once as either."""
    post = F.to_json(F.array(F.struct(F.col("doc_id").alias("timestamp"), F.array(F.struct(F.col("text").alias("post"))).alias("data"))))
    comment = F.to_json(F.struct(F.array(F.struct(F.col("doc_id").alias("timestamp"), F.array(F.struct(F.struct(F.col("text").alias("comment")).alias("comment"))).alias("data"))).alias("comments_v2")))
    rows = docs(spark, d)
    name = lambda head: F.concat(F.lit(head), F.col("doc_id"), F.lit(".json")).alias("entry")
    entries = rows.select(name("your_posts/posts_"), post.alias("content")).unionByName(rows.select(name("Comments/comments_"), comment.alias("content")))
    return connectors.facebook_documents(_archived(spark, entries, ["entry", "content"])).select("type", "timestamp", "text")


@query("SELECT 'Chat ' || conv_id || ' - user, assistant' AS title, sha256(string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def social_threads(spark, d):
    """Message threads of a social export."""
    people = F.array(F.struct(F.lit("user").alias("name")), F.struct(F.lit("assistant").alias("name")))
    message = F.struct("turn", F.struct(F.col("role").alias("sender_name"), F.col("turn").cast("long").alias("timestamp_ms"), F.col("text").alias("content")).alias("m"))
    convs = t(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(message)), lambda x: x["m"]).alias("messages"))
    thread = F.to_json(F.struct(F.concat(F.lit("Chat "), F.col("conv_id")).alias("title"), people.alias("participants"), "messages"))
    entries = convs.select(F.concat(F.lit("messages/inbox/"), F.col("conv_id"), F.lit("/message_1.json")).alias("entry"), thread.alias("content"))
    return connectors.facebook_documents(entries).select("title", F.sha2("text", 256).alias("digest"))


@query(f"SELECT conv_id, CAST(count(*) AS INT) AS messages FROM conversations WHERE {_CLEAN} GROUP BY 1")
def stored_exports(spark, d):
    """Exports written as JSON lines and read back."""
    message = F.struct(F.col("turn").cast("double").alias("create_time"), "role", F.col("text").alias("content"))
    convs = t(spark, d, "conversations").where(_CLEAN).groupBy(F.col("conv_id").cast("string").alias("id")).agg(F.sort_array(F.collect_list(message)).alias("messages"))
    path = fresh_path(spark, "exports")
    connectors.write_exports(convs.select("id", F.lit("t").alias("title"), F.lit(1.0).alias("create_time"), F.lit(1.0).alias("update_time"), "messages", F.lit("f").alias("export_file")), path)
    return connectors.read_exports(spark, path).select(F.col("id").cast("long").alias("conv_id"), F.size("messages").alias("messages"))


# Streams


def _landed(spark, d, name: str, rows: DataFrame) -> DataFrame:
    path = fresh_path(spark, f"landed-{name}")
    rows.write.parquet(path)
    return streams.landed(spark, path, spark.read.parquet(path).schema)


@query("SELECT doc_id, doc_id = min(doc_id) OVER (PARTITION BY text) AS added FROM documents")
def index_stream(spark, d):
    """Landed documents that a stream adds, and its job rows of the others."""
    out, checkpoint = fresh_path(spark, "stream-out"), fresh_path(spark, "stream-checkpoint")
    streams.index_stream(_landed(spark, d, "documents", docs(spark, d).select("doc_id", "text")), out, checkpoint).awaitTermination()
    added = spark.read.parquet(f"{out}/documents").select("doc_id", F.lit(True).alias("_added"))
    return spark.read.parquet(f"{out}/jobs").join(added, "doc_id", "left").select("doc_id", F.coalesce("_added", F.lit(False)).alias("added"))


def _drained(spark, result: DataFrame, mode: str) -> DataFrame:
    """All rows that a stream emits, written below one folder for each batch."""
    out, checkpoint = fresh_path(spark, "stream-out"), fresh_path(spark, "stream-checkpoint")
    result.writeStream.outputMode(mode).foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(StructType([*result.schema.fields, StructField("batch", IntegerType())])).parquet(out)


@query("SELECT conv_id, count(*) AS total_messages FROM conversations GROUP BY 1")
def merged_captures(spark, d):
    """Messages of each captured conversation, kept as state by a stream; every message lands twice."""
    c = t(spark, d, "conversations").select("conv_id", F.col("turn").alias("id"), F.concat(F.lit("Chat "), F.col("conv_id")).alias("title"))
    merged = keyed_state.merge_captures(_landed(spark, d, "captures", c.unionByName(c)), None)
    return _drained(spark, merged, "update").groupBy("conv_id").agg(F.max("total_messages").alias("total_messages"))


@query("""WITH e AS (SELECT user_id, ts, event_id, ts - lag(ts) OVER w > INTERVAL 1 HOUR AS pause FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(CASE WHEN pause THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e)
SELECT user_id, min(ts) AS "start", max(ts) AS "end", count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 1 HOUR < (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_user_sessions(spark, d):
    """Sessions of users that a stream closes by timers; those that may still go on are left open."""
    sessions = keyed_state.user_sessions(_landed(spark, d, "session-events", t(spark, d, "events")))
    return _drained(spark, sessions, "append").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT event_id FROM events")
def stream_messages_once(spark, d):
    """Events that land twice come out of a stream once."""
    e = t(spark, d, "events").select("event_id", "ts", "user_id")
    once = streams.new_messages(_landed(spark, d, "events", e.unionByName(e)), "ts", "1 day", ("event_id",))
    return _drained(spark, once, "append").select("event_id")


@query("SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def stream_event_windows(spark, d):
    """Hourly counts by a stream; the last state of each window counts."""
    windows = streams.event_windows(_landed(spark, d, "window-events", t(spark, d, "events")))
    return _drained(spark, windows.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n"), "update").groupBy("event_type", "start").agg(F.max("n").alias("n"))


@query("SELECT doc_id, CASE WHEN strlen(text) >= 2000 THEN 'long' ELSE 'short' END AS kind FROM documents WHERE regexp_matches(text, '[.!?]')")
def pattern_filter(spark, d):
    """Documents in which any of some patterns occurs."""
    return docs(spark, d).where(X.any_match(F.col("text"), [r"\.", "!", r"\?"])).select("doc_id", F.when(F.octet_length("text") >= 2000, "long").otherwise("short").alias("kind"))

