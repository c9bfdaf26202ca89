"""Document and chunk tables: adding, looking up, merging, deleting, counting.

Tables are DataFrames; an operator returns the new table, to be written by the
caller. Uniqueness and cascades are plans: anti joins, semi joins and windows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalore.functions.text import content_hash
from stratalore.session import materialize

DOCUMENTS = "id long, text string, metadata map<string,string>, content_hash string, created_at long, updated_at long"
CHUNKS = "id long, doc_id long, parent_chunk_id long, text string, enriched_text string, chunk_index int, char_start int, char_end int, level int, created_at long"
EMBEDDINGS = "chunk_id long, codes array<smallint>, scale double, offset double"


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """A table without rows, known as such to the planner: joins with it shuffle nothing."""
    return spark.createDataFrame([], schema).where(F.lit(False))


@dataclass
class Store:
    """The three tables of a collection."""

    documents: DataFrame
    chunks: DataFrame
    embeddings: DataFrame

    @classmethod
    def create(cls, spark: SparkSession) -> Store:
        return cls(empty(spark, DOCUMENTS), empty(spark, CHUNKS), empty(spark, EMBEDDINGS))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Store:
        return cls(*(spark.read.schema(s).parquet(f"{path}/{n}") for n, s in (("documents", DOCUMENTS), ("chunks", CHUNKS), ("embeddings", EMBEDDINGS))))

    def save(self, path: str) -> Store:
        """Write all tables to a new folder and return the store that reads them."""
        for n in ("documents", "chunks", "embeddings"):
            getattr(self, n).write.mode("errorifexists").parquet(f"{path}/{n}")
        return Store.load(self.documents.sparkSession, path)


def with_ids(rows: DataFrame, start: int, order: list[str]) -> DataFrame:
    """Adds ``id`` from ``start`` on in the given order, without bringing all rows together.

    Rows are sorted by range; each range numbers its rows from the total of those before it.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    ranged = materialize(ranged, "ids")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranged.groupBy("_part").agg(F.count("*").alias("n")).withColumn("_base", F.coalesce(F.sum("n").over(before), F.lit(0)) + start).drop("n")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.join(bases, "_part").withColumn("id", (F.col("_base") + own).cast("long")).drop("_part", "_base")


def first_of_each(rows: DataFrame, key: str, *order) -> DataFrame:
    """The first row of each key; rows without a key all stay."""
    ranked = rows.where(F.col(key).isNotNull()).withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank").unionByName(rows.where(F.col(key).isNull()))


def new_documents(existing: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """Incoming rows (with content_hash) whose hash is neither known nor earlier in the batch."""
    return first_of_each(incoming, "content_hash", order).join(existing.select("content_hash"), "content_hash", "left_anti")


def add_documents(store: Store, incoming: DataFrame, now: int = 0) -> tuple[Store, DataFrame]:
    """Add (text, metadata) rows; also a row of tallies: added, duplicates, errors (null texts)."""
    base = incoming.select("text", F.col("metadata").cast("map<string,string>").alias("metadata"), content_hash(F.col("text")).alias("content_hash"))
    good = base.where("text is not null")
    fresh = new_documents(store.documents, good, "content_hash")
    start = (store.documents.agg(F.max("id")).first()[0] or 0) + 1
    added = with_ids(fresh, start, ["content_hash"]).select("id", "text", "metadata", "content_hash", F.lit(now).cast("long").alias("created_at"), F.lit(None).cast("long").alias("updated_at"))
    n = base.agg(F.count("*").alias("n"), F.count("text").alias("good")).crossJoin(added.agg(F.count("*").alias("added"))).select("added", (F.col("good") - F.col("added")).alias("duplicates"), (F.col("n") - F.col("good")).alias("errors"))
    return Store(store.documents.unionByName(added), store.chunks, store.embeddings), n


def get_by_id(table: DataFrame, key: int, column: str = "id") -> DataFrame:
    return table.where(F.col(column) == key)


def find_by_hash(documents: DataFrame, value: str) -> DataFrame:
    return documents.where(F.col("content_hash") == value).limit(1)


def page(documents: DataFrame, number: int, size: int = 10, ascending: bool = False, by: str = "created_at", key: str = "id") -> DataFrame:
    """One page of documents, pages counted from 1."""
    order = [F.col(by).asc(), F.col(key).asc()] if ascending else [F.col(by).desc(), F.col(key).desc()]
    return documents.orderBy(*order).offset(max(0, number - 1) * size).limit(size)


def page_count(documents: DataFrame, size: int = 10) -> DataFrame:
    return documents.agg(F.count("*").alias("total"), F.ceil(F.count("*") / size).alias("total_pages"))


def document_with_chunks(store: Store, key: int) -> DataFrame:
    chunks = store.chunks.where(F.col("doc_id") == key).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "level", "text"))).alias("chunks"))
    return get_by_id(store.documents, key).join(chunks, F.col("id") == F.col("doc_id"), "left").drop("doc_id")


def merge_metadata(documents: DataFrame, changes: DataFrame, now: int) -> DataFrame:
    """Shallow merge of (id, metadata) changes: new values win; time stamps are set."""
    new = changes.select(F.col("id"), F.col("metadata").alias("_new"))
    joined = documents.join(new, "id", "left")
    changed = F.map_concat(F.col("_new"), F.create_map(F.lit("metadata_updated_at"), F.lit(str(now))))
    kept = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(changed, k))
    return joined.withColumn("metadata", F.when(F.col("_new").isNull(), F.col("metadata")).otherwise(F.map_concat(kept, changed))).withColumn("updated_at", F.when(F.col("_new").isNull(), F.col("updated_at")).otherwise(F.lit(now))).drop("_new")


def set_enriched_text(chunks: DataFrame, changes: DataFrame) -> DataFrame:
    new = changes.select(F.col("id"), F.col("enriched_text").alias("_new"))
    return chunks.join(new, "id", "left").withColumn("enriched_text", F.coalesce("_new", "enriched_text")).drop("_new").select(*chunks.columns)


def upsert_embeddings(embeddings: DataFrame, changes: DataFrame) -> DataFrame:
    """Changed chunks take their new vector; of several changes of one chunk an arbitrary but fixed one wins."""
    once = first_of_each(changes, "chunk_id", F.xxhash64("codes"))
    return embeddings.join(once.select("chunk_id"), "chunk_id", "left_anti").unionByName(once)


def keep_documents(store: Store, kept: DataFrame) -> Store:
    """The store of the documents in ``kept`` (id) with all that belongs to them."""
    documents = store.documents.join(kept.select("id"), "id", "left_semi")
    return prune_orphans(Store(documents, store.chunks, store.embeddings))


def delete_documents(store: Store, gone: DataFrame) -> Store:
    return prune_orphans(Store(store.documents.join(gone.select("id"), "id", "left_anti"), store.chunks, store.embeddings))


def prune_orphans(store: Store) -> Store:
    """Drop chunks without a document and embeddings without a chunk."""
    chunks = store.chunks.join(store.documents.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select(*store.chunks.columns)
    embeddings = store.embeddings.join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
    return Store(store.documents, chunks, embeddings)


def deduplicate(documents: DataFrame, key: str = "content_hash", newest: str = "id") -> DataFrame:
    """The newest row of each hash; rows without a hash stay."""
    return first_of_each(documents, key, F.desc(newest))


def evict_oldest(documents: DataFrame, n: int, by: str = "created_at", key: str = "id") -> DataFrame:
    """All but the ``n`` first rows by time and key, numbered range by range and so never gathered in one task."""
    numbered = with_ids(documents.select(F.col(by).alias("_by"), F.col(key).alias("_key")), 1, ["_by", "_key"])
    oldest = numbered.where(F.col("id") <= n).select(F.col("_key").alias(key))
    return documents.join(oldest, key, "left_anti")


def lacking_embedding(store: Store, limit: int | None = None) -> DataFrame:
    out = store.chunks.where("level = 1").join(store.embeddings.select(F.col("chunk_id").alias("id")), "id", "left_anti").select(*store.chunks.columns)
    return out.orderBy("id").limit(limit) if limit else out


def lacking_enrichment(chunks: DataFrame, limit: int | None = None) -> DataFrame:
    out = chunks.where("level = 1 and enriched_text is null")
    return out.orderBy("created_at", "id").limit(limit) if limit else out


def stats(store: Store) -> DataFrame:
    """One row of counts; null documents or chunks count zero."""
    d = store.documents.agg(F.count("*").alias("documents"))
    c = store.chunks.agg(F.count("*").alias("chunks"), F.count_if(F.col("level") == 0).alias("sections"), F.count_if(F.col("level") == 1).alias("paragraphs"), F.count_if(F.col("enriched_text").isNotNull()).alias("enriched"))
    e = store.embeddings.agg(F.count("*").alias("embeddings"), F.coalesce(F.max(F.size("codes")), F.lit(0)).alias("dim"))
    return d.crossJoin(c).crossJoin(e)  # three one-row tables


def surrounding(chunks: DataFrame, window: int = 1, doc: str = "doc_id", level: str | None = "level", index: str = "chunk_index", text: str = "text") -> DataFrame:
    """Every chunk with the texts of its neighbours within ``window`` places of the same level."""
    keys = [doc] + ([level] if level else [])
    w = Window.partitionBy(*keys).orderBy(index).rangeBetween(-window, window)
    return chunks.withColumn("context", F.transform(F.array_sort(F.collect_list(F.struct(F.col(index), F.col(text))).over(w)), lambda s: s[text]))


def parents(chunks: DataFrame) -> DataFrame:
    """Every chunk with its parent's text, null at the top."""
    up = chunks.select(F.col("id").alias("_pid"), F.col("text").alias("parent_text"))
    return chunks.join(up, chunks.parent_chunk_id == up._pid, "left").drop("_pid")


def siblings(chunks: DataFrame, key: int) -> DataFrame:
    """Chunks with the same parent as chunk ``key``, itself left out."""
    parent = chunks.where(F.col("id") == key).select(F.col("parent_chunk_id").alias("_p"))
    return chunks.join(parent, F.col("parent_chunk_id") == F.col("_p"), "left_semi").where(F.col("id") != key).orderBy("chunk_index")


def validate(store_tables: dict[str, DataFrame], dim: int = 384) -> DataFrame:
    """Rows (check, ok, detail): needed tables and columns, counts, dimension, orphans."""
    needed = {"documents": DOCUMENTS, "chunks": CHUNKS, "embeddings": EMBEDDINGS}
    spark = next(iter(store_tables.values())).sparkSession
    rows = []
    for name, schema in needed.items():
        there = name in store_tables
        rows.append((f"table {name}", there, ""))
        if there:
            missing = sorted(set(spark.createDataFrame([], schema).columns) - set(store_tables[name].columns))
            rows += [(f"columns of {name}", not missing, ",".join(missing)), (f"rows of {name}", True, str(store_tables[name].count()))]
    if all(n in store_tables for n in needed):
        s = Store(*(store_tables[n] for n in needed))
        orphans = s.chunks.count() - prune_orphans(s).chunks.count()
        found = stats(s).first().dim
        rows += [("orphan chunks", orphans == 0, str(orphans)), ("dimension", found in (0, dim), str(found))]
    return spark.createDataFrame(rows, "check string, ok boolean, detail string")
