"""Structured Streaming: landed files to documents, messages once, session and event windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from stratalore.functions.text import content_hash
from stratalore.streaming.ledger import HashLedger


def landed(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """A stream of rows from files as they land in a folder."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def index_stream(stream: DataFrame, out: str, checkpoint: str, enrich: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Append new documents (by content hash, also across batches) to ``out``/documents, and a job row for each to ``out``/jobs.

    A batch asks the ledger of hashes for those in its own buckets, and writes below its
    own number, so a repeated batch overwrites what it wrote and a restart neither loses
    nor doubles rows. Run with an available-now trigger.
    """

    def write(batch: DataFrame, number: int) -> None:
        ledger = HashLedger(batch.sparkSession, f"{out}/ledger")
        rows = batch.withColumn("content_hash", content_hash(F.col("text")))
        # Of equal texts the one with the smallest id is added, so a repeated batch gives the same rows.
        place = F.row_number().over(Window.partitionBy("content_hash").orderBy(F.asc_nulls_last("doc_id"), F.xxhash64(*batch.columns)))
        ranked = rows.where("text is not null").withColumn("_place", place)
        known = ledger.known(number, ranked).withColumn("_known", F.lit(True))
        ranked = ranked.join(known, "content_hash", "left").withColumn("_added", (F.col("_place") == 1) & F.col("_known").isNull()).persist()
        fresh = ranked.where("_added").select(*rows.columns)
        (enrich or (lambda d: d))(fresh).write.mode("overwrite").parquet(f"{out}/documents/batch={number}")
        jobs = ranked.select("doc_id", F.lit("completed").alias("status"), F.when(~F.col("_added"), "duplicate content").alias("error"))
        empty = rows.where("text is null").select("doc_id", F.lit("failed").alias("status"), F.lit("no text").alias("error"))
        jobs.unionByName(empty).write.mode("overwrite").parquet(f"{out}/jobs/batch={number}")
        ledger.add(number, fresh)
        ranked.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _timed(stream: DataFrame, at: str) -> DataFrame:
    """Watermarks need times with a zone; others count as in the session's."""
    return stream.withColumn(at, F.col(at).cast("timestamp"))


def new_messages(stream: DataFrame, at: str = "ts", late: str = "1 day", keys: tuple[str, ...] = ("conv_id", "id")) -> DataFrame:
    """Each message once, by conversation and id; state is dropped after ``late``."""
    return _timed(stream, at).withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))


def event_windows(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event type in tumbling or sliding windows; works on streams and tables."""
    ready = _timed(events, "ts").withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return ready.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def session_windows(events: DataFrame, gap: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    ready = _timed(events, "ts").withWatermark("ts", late) if events.isStreaming else events
    return ready.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
