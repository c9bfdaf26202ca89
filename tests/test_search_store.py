import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from stratalore.functions import vectors as VEC
from stratalore.operators import consent, jobs
from stratalore.operators import search as Q
from stratalore.operators import store as S
from stratalore.operators.consolidate import consolidate, tier_for
from stratalore.plans import verbs

CHUNKS = [(1, "Rust is a systems programming language with Node.js bindings"), (2, "Python is a programming language, a nice one"), (3, "Cafés and running; the runner ran café after café"), (4, "node and js apart"), (5, "programming programming programmer"), (6, None), (7, "")]


def test_porter_bm25_equals_sqlite(spark):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(text, tokenize='porter unicode61')")
    for k, t in CHUNKS:
        con.execute("insert into f(rowid, text) values (?, ?)", (k, t))
    index = Q.build_index(spark.createDataFrame(CHUNKS, "chunk_id long, text string"))
    for query in ("rust programming", "node.js", "cafe", "the the runner", "programming", "!!", "absent", "running café node.js"):
        match = " OR ".join(f'"{w}"' for w in query.split())
        want = con.execute("select rowid, -rank from f where f match ? order by rank, rowid", (match,)).fetchall()
        got = [(r.chunk_id, r.score) for r in Q.bm25(index, query, 10).collect()]
        assert dict(got) == pytest.approx(dict(want), abs=1e-9), query
        assert [k for k, _ in got][:1] == [k for k, _ in want][:1]


def test_vectors(spark):
    v = [0.1, 0.5, -0.3, 0.8, -0.1]
    df = spark.createDataFrame([(1, v), (2, [0.5] * 3), (3, [0.0] * 3)], "id long, v array<double>").withColumn("q", VEC.quantize(F.col("v")))
    rows = {r.id: r for r in df.withColumn("back", VEC.dequantize(F.col("q.codes"), F.col("q.scale"), F.col("q.offset"))).collect()}
    assert all(abs(a - b) < 0.01 for a, b in zip(v, rows[1].back))
    assert rows[2].q.scale == 0 and rows[2].q.offset == 0.5 and rows[2].q.codes == [0, 0, 0]
    vs = spark.createDataFrame([(1, [1.0, 0.5, 0.0]), (2, [0.1, 0.0, 1.0]), (3, [0.0, 0.0, 0.0])], "chunk_id long, vector array<double>")
    hits = Q.vector_search(vs, [1.0, 0.3, 0.0]).collect()
    assert [h.chunk_id for h in hits] == [1, 2, 3] and hits[0].score == pytest.approx((1 + 0.15) / math.sqrt(1.25 * 1.09))
    assert Q.vector_search(vs, [0.0] * 3).count() == 0


def test_fusion_boost_and_dedup(spark):
    a = spark.createDataFrame([(1, 9.0), (2, 8.0)], "chunk_id long, score double")
    b = spark.createDataFrame([(2, 0.9), (3, 0.8)], "chunk_id long, score double")
    got = {r.chunk_id: r.score for r in Q.fuse([a, b]).collect()}
    assert got == pytest.approx({1: 1 / 61, 2: 1 / 62 + 1 / 61, 3: 1 / 62})
    hits = spark.createDataFrame([(1, 10, 0.1, "topics: Microservice"), (2, 10, 0.2, None), (3, 11, 0.1, "x")], "chunk_id long, doc_id long, score double, enriched_text string")
    out = Q.best_per_document(Q.entity_boost(hits, "a microservice"), 5).collect()
    assert [(r.chunk_id, round(r.score, 2)) for r in out] == [(1, 0.25), (3, 0.1)]
    prompt = Q.rag_prompt(Q.rag_context(hits.withColumnRenamed("enriched_text", "text").withColumn("source", F.lit("s")), 0.15)).first().prompt
    assert "[1] (source: s)" in prompt or "[1]" not in prompt


def make(spark):
    store = S.Store.create(spark)
    rows = [("I love the gym and a good workout. " * 90, {"source": "a"}), ("Rust programming is fast.", {"source": "b"}), ("Rust programming is fast.", {"source": "c"}), (None, {"source": "d"})]
    return verbs.ingest(store, spark.createDataFrame(rows, "text string, metadata map<string,string>"), verbs.HashingEmbedder(16), now=5)


def test_ingest_distill_recall(spark):
    store, tally = make(spark)
    assert tuple(tally.first()) == (2, 1, 1)
    s = S.stats(store).first()
    assert s.documents == 2 and s.sections == 1 and s.paragraphs > 3 and s.embeddings == s.paragraphs and s.dim == 16
    ids = [r.id for r in store.chunks.collect()]
    assert len(set(ids)) == len(ids)
    child = store.chunks.where("parent_chunk_id is not null").first()
    assert S.get_by_id(store.chunks, child.parent_chunk_id).first().level == 0
    assert S.siblings(store.chunks, child.id).count() == s.paragraphs - 2
    again, tally = verbs.ingest(store, spark.createDataFrame([("Rust programming is fast.", {})], "text string, metadata map<string,string>"), now=6)
    assert tuple(tally.first()) == (0, 1, 0) and again.chunks.count() == store.chunks.count()
    rich, n = verbs.distill(store)
    assert n.first().enriched == s.paragraphs and S.lacking_enrichment(rich.chunks).count() == 0
    assert rich.chunks.where("enriched_text like 'topics: health%'").count() == s.paragraphs - 1
    for name in ("keyword", "entity", "vector", "hybrid", "timeline", "answer"):
        hits, used = verbs.recall(rich, verbs.Query("rust programming", name), embedder=verbs.HashingEmbedder(16))
        assert used == name and hits.first().text.startswith("Rust")
    assert verbs.recall(rich, verbs.Query("rust", source="zzz"))[0].count() == 0
    assert verbs.recall(rich, verbs.Query("rust", "hybrid", strict=True))[1] == "keyword"


def test_store_changes(spark):
    store, _ = make(spark)
    docs = store.documents.collect()
    gone = spark.createDataFrame([(docs[0].id,)], "id long")
    left = S.delete_documents(store, gone)
    assert left.documents.count() == 1 and left.chunks.select("doc_id").distinct().count() == 1 and left.embeddings.count() == left.chunks.where("level = 1").count()
    merged = S.merge_metadata(store.documents, spark.createDataFrame([(docs[0].id, {"topics": "rust", "source": "new"})], "id long, metadata map<string,string>"), 9)
    m = S.get_by_id(merged, docs[0].id).first()
    assert m.metadata["topics"] == "rust" and m.metadata["source"] == "new" and m.metadata["metadata_updated_at"] == "9" and m.updated_at == 9
    assert S.page(store.documents, 1, 1).count() == 1 and S.page_count(store.documents, 10).first().total_pages == 1
    assert S.document_with_chunks(store, docs[0].id).first().chunks
    assert S.find_by_hash(store.documents, docs[0].content_hash).count() == 1
    new = spark.createDataFrame([(store.embeddings.first().chunk_id, [1] * 16, 1.0, 0.0)], "chunk_id long, codes array<smallint>, scale double, offset double")
    assert S.upsert_embeddings(store.embeddings, new).count() == store.embeddings.count()
    report = {r.check: r.ok for r in S.validate({"documents": store.documents, "chunks": store.chunks, "embeddings": store.embeddings}, 16).collect()}
    assert all(report.values())
    orphan = S.Store(left.documents, store.chunks, store.embeddings)
    final, counts = consolidate(orphan)
    assert counts.first().orphans_removed > 0 and final.chunks.count() == left.chunks.count()
    assert [tier_for(1), tier_for(3), tier_for(5, True), tier_for(8, True), tier_for(1, board=True)] == ["base", "enhanced", "advanced", "full", "full"]


def test_save_and_load(spark, tmp_path):
    store, _ = make(spark)
    again = store.save(str(tmp_path / "s"))
    assert sorted(map(str, again.chunks.collect())) == sorted(map(str, store.chunks.select(*again.chunks.columns).collect()))


def test_consent_and_jobs(spark):
    full = consent.create(consent.empty(spark), "f", "2025-01-01 00:00:00")
    both = consent.create(full, "m", "2025-01-01 00:10:00", "minimal")
    got = {r.id: r for r in both.collect()}
    assert len(got["f"].allowed_categories) == 7
    ok = {r.id: (r.g, r.f, r.late) for r in both.select("id", consent.allows(F.lit("general")).alias("g"), consent.allows(F.lit("financial")).alias("f"), consent.allows(F.lit("general"), F.to_timestamp(F.lit("2025-01-01 01:05:00"))).alias("late")).collect()}
    assert ok == {"f": (True, True, False), "m": (True, False, True)}
    assert consent.revoke(both, "f").count() == 1
    assert consent.update_categories(both, "m", ["health"]).where("id = 'm'").first().preset == "custom"
    many = full
    rows = spark.createDataFrame([("q", "queued", None, None, None), ("p", "processing", None, None, None), ("x", "processing", None, None, None)], "id string, status string, document_id long, error string, completed_at long")
    done = jobs.outcome(rows, spark.createDataFrame([("p", None, "duplicate content"), ("x", None, "bad file")], "id string, document_id long, error string"), 7)
    assert {r.id: r.status for r in done.collect()} == {"q": "queued", "p": "completed", "x": "failed"}
    assert jobs.clean_up(done, 1).count() == 2 and many.count() == 1


def test_parents_follow_from_places_without_a_join(spark):
    from stratalore.operators import store as S
    from stratalore.plans import verbs

    text = "\n# One\n" + "a word. " * 600 + "\n## Two\n" + "more words here. " * 300
    rows = spark.createDataFrame([(text,), ("short",), (text + " end",)], "text string").selectExpr("text", "map('source', 'x') AS metadata")
    store, _ = verbs.ingest(S.Store.create(spark), rows)
    chunks = {r.id: r for r in store.chunks.collect()}
    assert sorted(chunks) == list(range(1, len(chunks) + 1)) and len({r.parent_chunk_id for r in chunks.values()}) == 5
    for r in chunks.values():
        if r.parent_chunk_id is not None:
            up = chunks[r.parent_chunk_id]
            assert up.level == 0 and up.doc_id == r.doc_id and up.chunk_index < r.chunk_index and r.text in up.text
    plan = store.chunks._jdf.queryExecution().optimizedPlan().toString()
    assert "parent_index" in plan and plan.count("Join") <= 1


def test_distill_shuffles_no_text(spark, sf):
    """Two scans of the texts, joined by what came of them; nothing of the other two is in the plan."""
    from stratalore.plans.collection_queries import distill_documents

    rows = distill_documents(spark, sf)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2 and plan.count("FileScan") == 2 and "NestedLoop" not in plan
    assert dict(rows.dtypes) == {"doc_id": "bigint", "topics": "string", "dim": "int", "enriched": "bigint", "embedded": "bigint"}
