"""Indexing jobs and file manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ["queued", "processing", "completed", "failed"]


def status_counts(jobs: DataFrame, col: str = "status") -> DataFrame:
    return jobs.agg(*[F.count_if(F.col(col) == s).alias(s) for s in STATUSES])


def newest_first(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(F.desc("queued_at"), "id")


def clean_up(jobs: DataFrame, keep: int = 100) -> DataFrame:
    """Open jobs and the last finished ones; only the finished ones that stay are ordered."""
    done = F.col("status").isin("completed", "failed")
    last = jobs.where(done).orderBy(F.desc("completed_at"), "id").limit(keep)
    return jobs.where(~done).unionByName(last)


def outcome(jobs: DataFrame, results: DataFrame, now: int) -> DataFrame:
    """Jobs with the outcome (id, document_id, error) of a run; a duplicate is completed with an error text."""
    r = results.select("id", F.col("document_id").alias("_doc"), F.col("error").alias("_error"), F.lit(True).alias("_ran"))
    failed = F.col("_doc").isNull() & F.col("_error").isNotNull() & ~F.lower(F.coalesce("_error", F.lit(""))).contains("duplicate")
    joined = jobs.join(r, "id", "left")
    return joined.withColumns({
        "status": F.when(F.col("_ran").isNull(), F.col("status")).when(failed, "failed").otherwise("completed"),
        "document_id": F.coalesce("_doc", "document_id"),
        "error": F.coalesce("_error", "error"),
        "completed_at": F.when(F.col("_ran").isNotNull(), F.lit(now).cast("long")).otherwise(F.col("completed_at")),
    }).drop("_doc", "_error", "_ran").select(*jobs.columns)


def sessions_by_gap(events: DataFrame, gap_seconds: int = 3600, user: str = "user_id", at: str = "ts", tie: str = "event_id") -> DataFrame:
    """Events with a session number that grows after each pause of over ``gap_seconds``."""
    w = Window.partitionBy(user).orderBy(at, tie)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    pause = micros - F.lag(micros).over(w)
    started = events.withColumn("_new", F.when(pause.isNull() | (pause > gap_seconds * 1_000_000), 1).otherwise(0))
    return started.withColumn("session", F.sum("_new").over(w)).drop("_new")
