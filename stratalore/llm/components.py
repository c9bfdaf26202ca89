"""Connected components of an edge table by alternating large-star and small-star steps.

Each step re-hangs nodes below the smallest node they see; after a few rounds
every node hangs directly below the smallest node of its component. All state
stays in tables in the shared folder; the driver sees one checksum a round.
Every join reads tables from files on both sides, so adaptive execution can
split the rows of a node with very many neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalore.session import materialize

#: Rounds after which a run is given up as an error; the method needs O(log^2 nodes).
MAX_ROUNDS = 60


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _smallest(pairs: DataFrame, name: str) -> DataFrame:
    """For each u the smallest of itself and its v, as a written table."""
    return materialize(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), name)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (u, v: long); root is its component's smallest node.

    Loops and repeated edges are allowed; null ends are ignored; no edges give no rows.
    """
    edges = materialize(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _smallest(both, "cc-large")
        large = materialize(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "cc-large-edges")
        low = _smallest(large, "cc-small")
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = materialize(small.where("u <> v").distinct(), "cc-small-edges")
        now = _checksum(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("connected components did not settle")
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
