"""Consent sessions: creating, checking, revoking, filtering by category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalore.functions.vocabulary import CATEGORIES

SCHEMA = "id string, allowed_categories array<string>, preset string, created_at timestamp, expires_at timestamp, active boolean"
PRESETS = {"full": CATEGORIES, "professional": ["professional", "technical", "general"], "minimal": ["general"]}
MAX_SESSIONS, MINUTES = 100, 60


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def create(sessions: DataFrame, key: str, now: str, preset: str = "full", categories: list[str] | None = None, minutes: int = MINUTES) -> DataFrame:
    """Adds a session; the oldest go when there are more than ``MAX_SESSIONS``."""
    allowed = PRESETS.get(preset) or categories or ["general"]
    at = F.to_timestamp(F.lit(now))
    row = sessions.sparkSession.range(1).select(F.lit(key).alias("id"), F.array(*map(F.lit, allowed)).alias("allowed_categories"), F.lit(preset).alias("preset"), at.alias("created_at"), (at + F.make_interval(mins=F.lit(minutes))).alias("expires_at"), F.lit(True).alias("active"))
    newest = F.row_number().over(Window.orderBy(F.desc("created_at"), "id"))
    return sessions.unionByName(row).withColumn("_n", newest).where(F.col("_n") <= MAX_SESSIONS).drop("_n")


def revoke(sessions: DataFrame, key: str) -> DataFrame:
    return sessions.where(F.col("id") != key)


def update_categories(sessions: DataFrame, key: str, categories: list[str]) -> DataFrame:
    mine = F.col("id") == key
    return sessions.withColumn("allowed_categories", F.when(mine, F.array(*map(F.lit, categories))).otherwise(F.col("allowed_categories"))).withColumn("preset", F.when(mine, "custom").otherwise(F.col("preset")))


def allows(category: Column, now: Column | None = None) -> Column:
    """Whether a session row lets a category through; with ``now`` expired sessions do not."""
    ok = F.col("active") & F.array_contains("allowed_categories", category)
    return ok & (F.col("expires_at") > now) if now is not None else ok


def permitted(rows: DataFrame, session: DataFrame, category_col: str = "category") -> DataFrame:
    """Rows whose category the (one-row) session allows."""
    open_ = session.where("active").select(F.explode("allowed_categories").alias("_c")).distinct()
    return rows.join(F.broadcast(open_), F.col(category_col) == F.col("_c"), "left_semi")
