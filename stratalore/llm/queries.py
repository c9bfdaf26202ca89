"""Queries of the operators in this subpackage over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Vocabulary that the queries count and encode with.
VOCABULARY = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalore.llm.token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalore.llm.line_quality import quality_rules

    return quality_rules(_table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalore.llm.simhash import hex16, near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), threshold=2, shingle=3).select("doc_id", hex16("fp").alias("fingerprint"), "component_id")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalore.llm.decontaminate import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalore.llm.pii import pii_report

    return pii_report(_table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalore.llm.warc import archive_pages

    return archive_pages(_table(spark, sf_dir, "pages"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalore.llm.pairwise_quality import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalore.llm.token_files import token_files

    return token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), end=1)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalore.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents")).drop("copies")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalore.llm.language_crf import identify

    return identify(_table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalore.llm.hard_negatives import mine

    vectors = _table(spark, sf_dir, "embeddings")
    label = F.when(vectors["vec_id"] % 7 == 0, (vectors["label"] + 1) % 10).otherwise(vectors["label"])
    return mine(vectors, label, vectors["vec_id"] % 100 == 0)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalore.llm.ranked_search import top_documents

    return top_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalore.llm.bpe_codec import round_trips

    return round_trips(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from stratalore.llm import sql

    return {"op2_quality_rules": sql.QUALITY_RULES, "op5_warc": sql.WARC, "op6_decontamination": sql.DECONTAMINATION, "op9_mixing": sql.MIXING, "op11_hard_negatives": sql.HARD_NEGATIVES, "op12_ranked_search": sql.RANKED_SEARCH}
