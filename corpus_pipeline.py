"""From raw documents to token files: the stages of a training corpus.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before
kept. All stages but the last return the columns of ``docs`` as they are, further
ones included, whatever their names; only doc_id, text and source are looked at. The
last returns one row for each document of the token files. An empty table goes
through every stage and stays empty; rows are told apart by their place in the
files, so null and repeated ids are no special case; texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stratalore.llm.decontaminate import drop_contaminated
from stratalore.llm.mixing import mixture
from stratalore.llm.near_copies import drop_near_copies
from stratalore.llm.pairwise_quality import drop_low_quality
from stratalore.llm.queries import VOCABULARY
from stratalore.llm.token_files import token_files
from stratalore.session import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise classifier accepts.

    A null text counts as empty and has a score like any other; repeated rows share
    their score and stay or go together; without labels of both kinds all stay.
    """
    return drop_low_quality(docs, _table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash links and shared bands propose pairs, a similarity of 0.8 or
    more of their five-word shingles confirms them.

    The one with the smallest id stays, a null id being the largest. Of equal ids the
    smallest digest of the text wins, of equal texts the first in the files. Texts
    without words (null, empty, white space) form one group.
    """
    return drop_near_copies(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than 5% of the words lie in benchmark windows.

    A text without words is clean and stays; repeated rows stay or go together.
    """
    return drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    A text without words is never taken; a null source is a source; equal keys, as
    repeated rows have, go by their place in the files.
    """
    return mixture(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and one row for each document in them.

    A null or empty text has the end id only; null ids come first, repeated ids follow each other.
    """
    return token_files(docs, public_tokenizers.path(VOCABULARY), end=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
    ("token-ID / binary output", token_output),
]

#: The classifier and the fingerprints have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each result written to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{number}")
    return docs
