import pytest
from pyspark.sql import functions as F

from stratalore.operators import keyword_index as K
from stratalore.operators import search as Q

SCHEMA = "chunk_id long, text string, note string, level int"
WORDS = ["river", "stone", "the", "running", "café", "node.js", "moon", "a"]


def table(spark, rows):
    return spark.createDataFrame([(i, t, n, v) for i, (t, n, v) in rows.items()], SCHEMA)


def rows_of(n, shift=0):
    return {i: (" ".join(WORDS[(i * k + shift) % 8] for k in range(i % 9 + 1)), WORDS[i % 8] if i % 3 else None, i % 2) for i in range(n)}


def build(spark, rows, stemmed=True):
    return Q.build_index(table(spark, rows), stemmed, text_cols=("text", "note"), level_col="level")


def scores(index, query="the running river node.js cafe"):
    return {r.chunk_id: round(r.score, 9) for r in Q.bm25(index, query, None).collect()}


def same(spark, index, rows, stemmed=True):
    fresh = build(spark, rows, stemmed)
    assert (index.chunks, index.version.words) == (fresh.chunks, fresh.version.words)
    assert scores(index) == scores(fresh)
    assert Q.bm25(index, "running", None, level=1).count() == Q.bm25(fresh, "running", None, level=1).count()


@pytest.mark.parametrize("stemmed", [True, False])
def test_changes_cost_what_they_touch(spark, stemmed):
    rows = rows_of(300)
    index = build(spark, rows, stemmed)
    assert [s.chunks for s in index.version.segments] == [300]
    changed = {i: ("moon moon river the", None, 1) for i in (3, 150, 299)} | {1000: ("a new running river", "x", 1)}
    deleted = [7, 8, 9, 5000]
    rows = {k: v for k, v in (rows | changed).items() if k not in deleted}
    index = index.apply(table(spark, changed), spark.createDataFrame([(k,) for k in deleted], "chunk_id long"))
    # Only the four changed rows were cut into words: the old segment is as it was.
    assert [s.chunks for s in index.version.segments] == [300, 4]
    same(spark, index, rows, stemmed)
    # A chunk that comes back is live again, and one changed twice counts once.
    again = {7: ("the moon", None, 0), 1000: ("river", None, 0)}
    rows |= again
    index = index.apply(table(spark, again))
    assert [s.chunks for s in index.version.segments] == [300, 4, 2]
    same(spark, index, rows, stemmed)
    whole = index.merge()
    assert [s.chunks for s in whole.version.segments] == [len(rows)] and not whole.version.tombstones
    same(spark, whole, rows, stemmed)


def test_sync_finds_the_changes(spark):
    rows = rows_of(120)
    index = build(spark, rows)
    assert index.sync(table(spark, rows)).version.number == index.version.number
    rows = {k: v for k, v in rows.items() if k != 5} | {6: ("river", None, 1), 7: (rows[7][0], rows[7][1], 1 - rows[7][2]), 500: (None, None, 1)}
    synced = index.sync(table(spark, rows))
    assert sorted(s.chunks for s in synced.version.segments) == [3, 120]
    same(spark, synced, rows)
    # A table with rows that share an id: all of them are replaced together.
    twice = table(spark, rows).unionByName(table(spark, {6: ("stone", None, 1)}))
    double = synced.sync(twice)
    assert double.chunks == len(rows) + 1 and double.version.segments[-1].chunks == 2
    back = double.sync(table(spark, rows))
    assert back.chunks == len(rows) and back.sync(table(spark, {})).chunks == 0


def test_small_segments_are_merged_and_versions_load(spark):
    rows = rows_of(200)
    index = build(spark, rows)
    for k in range(2 * K.FANOUT):
        change = {1000 + k: (f"river number{k}", None, 1), k: ("stone", None, 1)}
        rows |= change
        index = index.apply(table(spark, change))
    assert len(index.version.segments) <= K.FANOUT + 1
    same(spark, index, rows)
    loaded = K.KeywordIndex.load(spark, index.path)
    assert loaded.version == index.version and scores(loaded) == scores(index)
    old = K.KeywordIndex(**{**vars(index), "version": K.Version(**{**vars(index.version), "number": 3})})
    with pytest.raises(Exception, match="(?i)exists"):  # another writer has published that version
        old.apply(table(spark, {1: ("x", None, 1)}))
    # Many deletions: all that is dead goes.
    index = index.apply(None, spark.createDataFrame([(i,) for i in range(0, 150)], "chunk_id long"))
    assert len(index.version.segments) == 1 and index.version.segments[0].chunks == index.chunks
    same(spark, index, {k: v for k, v in rows.items() if k >= 150})


def test_odd_tables(spark):
    index = build(spark, {})
    assert index.chunks == 0 and index.average == 0 and Q.bm25(index, "river").count() == 0
    index = index.apply(table(spark, {1: (None, None, 1), 2: ("", "", 1), 3: ("long " * 5000 + "river", "river stone", 1)}))
    assert index.chunks == 3 and index.version.words == 5003
    assert [r.chunk_id for r in Q.bm25(index, "river.stone").collect()] == [3]
    # The last word of a column and the first of the next are no phrase.
    assert Q.bm25(index, "long.river.river").count() == 0
    with pytest.raises(Exception, match="without an id"):
        index.apply(table(spark, {None: ("x", None, 1)}))


def test_a_shared_index_follows_its_files(spark, tmp_path):
    path, rows = str(tmp_path / "t"), rows_of(40)
    table(spark, rows).write.parquet(path)
    read = lambda: Q.shared_index(spark.read.parquet(path), True, text_cols=("text", "note"), level_col="level")
    first = read()
    assert read() is first
    more = {100: ("river", None, 1)}
    table(spark, more).write.mode("append").parquet(path)
    second = read()
    assert second.path == first.path and second.version.segments[-1].chunks == 1
    same(spark, second, rows | more)


def test_frequent_words_are_split_over_files(spark):
    """A word in every chunk takes several files where its size asks for it."""
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20k")
    try:
        many = spark.range(20000).select(F.col("id").alias("chunk_id"), F.concat(F.lit("the w"), F.col("id")).alias("text")).repartition(8)
        index = Q.build_index(many, False)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = index.of(["the"]).select(F.input_file_name().alias("f")).distinct().count()
    assert files > 1 and index.of(["the"]).count() == 20000


def test_memory_of_a_worker_is_bounded_by_words():
    """A batch becomes postings piece by piece; the pieces together have the batch's postings, in order of terms."""
    import pyarrow as pa

    from stratalore.operators import keyword_index as KI

    words = [["b", "a", "b"], [], [], ["c"] * 50, ["a"], ["d", "a"], []]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7), pa.int64()), pa.array([1] * 7, pa.int32()), pa.array(range(7, 14), pa.int64()), pa.array(words, pa.list_(pa.string()))], ["chunk_id", "level", "digest", "words"])
    for size in (1, 3, 4, 1000):
        cut = list(KI.pieces(batch, size))
        assert [i for p in cut for i in p.column(0).to_pylist()] == list(range(7))
        assert all(p.num_rows == 1 or sum(len(w or []) for w in p.column(3).to_pylist()) <= size for p in cut)
        got = [r for p in cut for r in KI.postings_of(p, list).to_pylist()]
        assert sorted((r["chunk_id"], r["term"], r["tf"], r["positions"]) for r in got if r["term"]) == [(0, "a", 1, [1]), (0, "b", 2, [0, 2]), (3, "c", 50, [*range(50)]), (4, "a", 1, [0]), (5, "a", 1, [1]), (5, "d", 1, [0])]
        assert sorted((r["chunk_id"], r["length"], r["digest"]) for r in got if r["term"] is None) == [(i, len(w or []), i + 7) for i, w in enumerate(words)]
        assert all(r["digest"] is None for r in got if r["term"])
    assert not list(KI.pieces(batch.slice(0, 0)))


def test_queries_of_the_store_alone_make_no_index(spark, sf, monkeypatch):
    import __spark_entry__ as entry
    from stratalore.operators import search

    monkeypatch.setattr(search, "build_index", lambda *a: 1 / 0)
    monkeypatch.setattr(search, "_indexes", type(search._indexes)())
    for name in ("pending_enrichment", "distill_documents", "chunk_by_id", "store_report", "delete_documents"):
        entry.queries()[name](spark, sf)
