"""Token counts of whole texts by rank-synchronous array merging (see ``bpe``).

Texts are cut at ASCII white space, which the tokenizer drops and across which
no normalisation or merge reaches; each distinct word of a batch is merged once
and its count reused through a bounded memo.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows
and repeated ids give one row each; an empty table gives an empty table; other
columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from stratalore.session import bound_batches, ship

#: Distinct words that one worker remembers before it starts afresh.
MEMO_WORDS = 400_000
#: Bytes of new distinct words that are merged in one array batch.
MERGE_BYTES = 4 << 20

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
_mergers: dict = {}


def merger_of(spec: str):
    from stratalore.llm.bpe import RankMerger

    key = hash(spec)
    if key not in _mergers:
        _mergers.clear()
        _mergers[key] = (RankMerger(spec), {})
    return _mergers[key]


def _learn(merger, memo: dict, new: list[bytes]) -> None:
    part, size = [], 0
    for word in new:
        part.append(word)
        size += len(word)
        if size >= MERGE_BYTES:
            memo.update(zip(part, merger.count_words(part), strict=True))
            part, size = [], 0
    if part:
        memo.update(zip(part, merger.count_words(part), strict=True))


def counts_of(texts: list[bytes | None], merger, memo: dict) -> list[int]:
    words = [t.split() if t else [] for t in texts]
    if len(memo) > MEMO_WORDS:
        memo.clear()
    new = set().union(*words).difference(memo)
    _learn(merger, memo, list(new))
    look = memo.__getitem__
    return [sum(map(look, w)) for w in words]


def count_tokens(docs: DataFrame, tokenizer_file: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, bytes, tokens and whether tokens exceed ``limit``.

    ``tokenizer_file`` is a ``tokenizers`` JSON file on the driver; its text, whose
    size is fixed by the vocabulary, is broadcast.
    """
    spark = docs.sparkSession
    ship(spark)
    bound_batches(spark)
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from stratalore.llm.token_counts import counts_of, merger_of

        merger, memo = merger_of(spec.value)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            n = counts_of(texts, merger, memo)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return picked.mapInArrow(run, SCHEMA)
