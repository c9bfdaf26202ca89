"""Queries of collection state, uploads and chats over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalore.functions import text as X
from stratalore.operators import consent, jobs, search
from stratalore.operators import store as S
from stratalore.plans import verbs
from stratalore.plans.collection_queries import _store
from stratalore.plans.queries import _PROMPT_SQL, WORDS, _hybrid, docs, query, t
from stratalore.sources import connectors


@query("SELECT doc_id AS id, 1 AS level, sha256(text) AS digest FROM documents WHERE doc_id = 11")
def chunk_by_id(spark, d):
    return S.get_by_id(_store(spark, d).chunks, 11).select("id", "level", F.sha2("text", 256).alias("digest"))


@query("""WITH n AS (SELECT CAST(count(*) AS VARCHAR) AS n FROM documents)
SELECT unnest(['table documents', 'columns of documents', 'rows of documents', 'table chunks', 'columns of chunks', 'rows of chunks', 'table embeddings', 'columns of embeddings', 'rows of embeddings', 'orphan chunks', 'dimension']) AS "check", true AS ok,
unnest(['', '', n, '', '', n, '', '', '0', '0', '0']) AS detail FROM n""")
def store_report(spark, d):
    """What the validator says of a store filled from the table."""
    store = _store(spark, d)
    return S.validate({"documents": store.documents, "chunks": store.chunks, "embeddings": store.embeddings})


@query("SELECT count(DISTINCT text) + 1 AS documents, CAST(1 AS BIGINT) AS added, CAST(1 AS BIGINT) AS duplicates, CAST(1 AS BIGINT) AS errors FROM documents")
def add_one_by_one(spark, d):
    """A new text, a known one and a null one added to a full store."""
    rows = docs(spark, d)
    hashed = rows.select(F.col("doc_id").alias("id"), "text", F.create_map().cast("map<string,string>").alias("metadata"), X.content_hash(F.col("text")).alias("content_hash"), F.col("doc_id").alias("created_at"), F.lit(None).cast("long").alias("updated_at"))
    store = S.Store(S.deduplicate(hashed), S.empty(spark, S.CHUNKS), S.empty(spark, S.EMBEDDINGS))
    known = rows.where("doc_id = 5").select("text")
    new = spark.createDataFrame([("A text that no document has.",), (None,)], "text string").unionByName(known)
    grown, tally = S.add_documents(store, new.withColumn("metadata", F.create_map().cast("map<string,string>")))
    return tally.crossJoin(grown.documents.agg(F.count("*").alias("documents"))).select("documents", "added", "duplicates", "errors")  # two one-row tables


@query("""WITH c AS (SELECT conv_id, string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations WHERE role IS NOT NULL AND text IS NOT NULL GROUP BY 1)
SELECT sha256(text) AS content_hash, 'captured' AS source, count(*) > 0 AS there FROM c WHERE text <> '' GROUP BY text""")
def connector_indexing(spark, d):
    """Captured conversations put through normal ingest: hashed, each text once, cut into chunks."""
    rows = connectors.captured_documents(t(spark, d, "conversations")).select("text", F.create_map(F.lit("source"), F.lit("captured")).alias("metadata"))
    store, _ = verbs.ingest(S.Store.create(spark), rows)
    cut = store.chunks.where("level = 1").select(F.col("doc_id").alias("id")).distinct().withColumn("there", F.lit(True))
    return store.documents.join(cut, "id", "left").select("content_hash", F.element_at("metadata", "source").alias("source"), F.coalesce("there", F.lit(False)).alias("there"))


@query("SELECT doc_id, source, doc_id || '.txt' AS filename, lang FROM documents")
def metadata_names(spark, d):
    """Source, file name and language out of the metadata of each chunk."""
    raw = F.to_json(F.struct("source", F.concat("doc_id", F.lit(".txt")).alias("filename"), F.struct("n_chars").alias("more"), "lang"))
    m = docs(spark, d).select("doc_id", X.metadata_map(raw).alias("m"))
    return m.select("doc_id", *[F.element_at("m", k).alias(k) for k in ("source", "filename", "lang")])


@query("SELECT event_id AS id, event_type AS status FROM events ORDER BY ts DESC, event_id LIMIT 50")
def newest_jobs(spark, d):
    """The first page of jobs by the time they were queued."""
    rows = t(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("status"), F.col("ts").alias("queued_at"))
    return jobs.newest_first(rows).limit(50).select("id", "status")


@query("""WITH s AS (SELECT CAST(event_id AS VARCHAR) AS id, ts FROM events UNION ALL SELECT 'new', TIMESTAMP '2030-01-01 00:00:00')
SELECT id, CASE WHEN id = 'new' THEN 3 ELSE 1 END AS categories FROM s ORDER BY ts DESC, id LIMIT 100""")
def consent_sessions(spark, d):
    """A new consent session among as many as there are events: the newest hundred stay."""
    start = F.col("ts").cast("timestamp")
    rows = t(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.array(F.lit("general")).alias("allowed_categories"), F.lit("minimal").alias("preset"), start.alias("created_at"), (start + F.expr("INTERVAL 1 HOUR")).alias("expires_at"), F.lit(True).alias("active"))
    return consent.create(rows, "new", "2030-01-01 00:00:00", "professional").select("id", F.size("allowed_categories").alias("categories"))


@query("""WITH s AS (SELECT min(source) AS site FROM documents), m AS (SELECT doc_id, n_chars FROM documents, s WHERE source = s.site AND doc_id % 3 <> 0)
SELECT doc_id AS id, n_chars AS updated_at, (SELECT count(*) FROM m) AS total FROM m ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 5""".replace("OFFSET 5", "OFFSET 20"))
def site_conversations(spark, d):
    """The second page of one site's conversations after some were deleted."""
    rows = docs(spark, d).select(F.col("doc_id").alias("id"), F.col("source").alias("site"), F.col("n_chars").alias("updated_at"))
    left = connectors.delete_conversations(rows, rows.where("id % 3 = 0"))
    page, total = connectors.conversations_of(left, rows.agg(F.min("site")).first()[0], 2, 20)
    return page.crossJoin(F.broadcast(total)).select("id", "updated_at", "total")  # one row of totals


@query(f"""WITH prompt AS ({_PROMPT_SQL})
SELECT 0 AS place, 'system' AS role, prompt AS content FROM prompt
UNION ALL SELECT CAST(row_number() OVER (ORDER BY turn) AS INT), role, text FROM conversations WHERE conv_id = 3
UNION ALL SELECT CAST((SELECT count(*) FROM conversations WHERE conv_id = 3) + 1 AS INT), 'user', '{WORDS}'""")
def chat_request(spark, d):
    """The messages of a chat request: prompt with context, the talk so far, the question."""
    hits = docs(spark, d).join(F.broadcast(_hybrid(spark, d)), F.col("doc_id") == F.col("chunk_id"))
    history = t(spark, d, "conversations").where("conv_id = 3").select("turn", "role", F.col("text").alias("content"))
    return search.chat_messages(search.rag_context(hits, 0.0125), history, WORDS)


@query("""WITH n AS (SELECT page_id, replace(replace(replace(url, '/', ''), '\\', ''), '..', '') AS name FROM pages)
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN name WHEN contains(name[2:], '.') THEN regexp_replace(name, '\\.[^.]*$', '') || '_20250101000000' || CASE WHEN ends_with(name, '.') THEN '' ELSE regexp_extract(name, '\\.[^.]*$') END ELSE name || '_20250101000000' END AS name FROM n""")
def upload_names(spark, d):
    """Names of uploads, those of every second page already taken."""
    rows = t(spark, d, "pages").select("page_id", "url", (F.col("page_id") % 2 == 1).alias("taken"))
    return rows.select("page_id", X.unique_filename(F.col("url"), F.col("taken"), "20250101000000").alias("name"))
