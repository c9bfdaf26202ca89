"""Keeping a collection within its tier: prune, remove duplicates, evict."""

from __future__ import annotations

from pyspark.sql import DataFrame

from stratalore.functions.vocabulary import TIER_LIMITS
from stratalore.operators import store as S


#: Least memory in GB of each tier, best first, and whether it needs graphics.
_TIER_NEEDS = [("full", 6.0, True), ("advanced", 4.0, True), ("enhanced", 2.0, False)]


def tier_for(ram_gb: float, gpu: bool = False, board: bool = False) -> str:
    """Tier of a machine by memory and graphics; a known accelerator board has the best one."""
    if board:
        return "full"
    return next((name for name, least, needs in _TIER_NEEDS if ram_gb >= least and (gpu or not needs)), "base")


def consolidate(store: S.Store, tier: str = "base", chunk_limit: bool = False) -> tuple[S.Store, DataFrame]:
    """The smaller store and a row of what went: orphan chunks, duplicates, evicted documents."""
    limit = TIER_LIMITS[tier]
    spark = store.documents.sparkSession
    pruned = S.prune_orphans(store)
    orphans = store.chunks.count() - pruned.chunks.count()
    unique = S.keep_documents(pruned, S.deduplicate(pruned.documents))
    before, after = pruned.documents.count(), unique.documents.count()
    over = max(0, after - limit["max_documents"])
    if chunk_limit:
        average = unique.chunks.count() / max(1, after)
        over = max(over, int(max(0.0, unique.chunks.count() - limit["max_chunks"]) / max(1.0, average)))
    final = S.prune_orphans(S.Store(S.evict_oldest(unique.documents, over), unique.chunks, unique.embeddings)) if over else unique
    report = spark.createDataFrame([(orphans, before - after, over)], "orphans_removed long, duplicates_removed long, evicted long")
    return final, report
