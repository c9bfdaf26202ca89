"""A written matrix of vectors that grows by appending and answers from few of its cells.

Rows lie in folders by *cell*, the nearest of some centroids, which are fitted once on a
bounded sample. A row has its one-byte codes with scale and offset, the sum of the codes
and the length of the vector that they stand for, and beside them the exact vector. A
query computes nothing over that is written: it opens its nearest cells, scores their
codes by integer products, and ranks the best of these again by the exact cosine. Exact
mode reads the exact vectors of all cells instead.

Appending writes one more folder of rows and a new version of the list of folders;
vectors of nearly no length are skipped. Deleted ids are kept as such and left out of
answers until ``compact`` writes their folders anew.

Defined results: a null vector, one with a null or non-finite component, or one of
another length than the first is skipped; of rows with one id in several folders the
last appended counts; a query of no length finds nothing; equal scores go by id; an empty
matrix answers with no rows.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalore.functions.vectors import TINY, cosine_to
from stratalore.session import fresh_path, ship

#: Rows that centroids are fitted on, cells at most, rounds of fitting, rows ranked again for each that is wanted.
SAMPLE, CELLS, ROUNDS, AGAIN = 20_000, 1024, 12, 10
_ROWS = "chunk_id long, codes binary, scale double, offset double, total long, length double, vector array<double>, number int"


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Unit centroids of unit vectors; the first ones are chosen far from each other."""
    rng = np.random.default_rng(seed)
    out = sample[[rng.integers(len(sample))]]
    near = sample @ out[0]
    for _ in range(min(cells, len(sample)) - 1):
        gap = np.maximum(1 - near, 0) + 1e-12
        out = np.vstack((out, sample[rng.choice(len(sample), p=gap / gap.sum())]))
        near = np.maximum(near, sample @ out[-1])
    for _ in range(rounds):
        own = np.argmax(sample @ out.T, axis=1)
        for c in range(len(out)):
            if (own == c).any():
                mean = sample[own == c].mean(axis=0)
                out[c] = mean / max(np.linalg.norm(mean), TINY)
    return out


def encoded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (uint8) of rows, their scales and offsets; a constant row has zeros and scale 0."""
    low, high = x.min(axis=1), x.max(axis=1)
    scale = np.where(high - low < TINY, 0.0, (high - low) / 255)
    codes = np.floor((x - low[:, None]) / np.where(scale > 0, scale, 1)[:, None] + 0.5)
    return np.clip(np.where(scale[:, None] > 0, codes, 0), 0, 255).astype(np.uint8), scale, low


def code_scores(codes: np.ndarray, scale: np.ndarray, offset: np.ndarray, total: np.ndarray, length: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosines of coded rows with a query, from integer products of codes."""
    q, q_scale, q_offset = (x[0] for x in encoded(query[None, :]))
    product = codes.astype(np.int32) @ q.astype(np.int32)
    dots = scale * q_scale * product + scale * q_offset * total + offset * q_scale * int(q.sum()) + len(q) * offset * q_offset
    return dots / np.maximum(length * np.linalg.norm(query), TINY)


@dataclass
class VectorMatrix:
    """A matrix in a folder, at one version."""

    spark: SparkSession
    path: str
    centroids: list[list[float]]
    version: int = 0
    folders: list[str] = field(default_factory=list)
    deleted: list[str] = field(default_factory=list)

    @classmethod
    def create(cls, vectors: DataFrame, cells: int | None = None, path: str | None = None, id_col: str = "chunk_id", vector_col: str = "vector") -> VectorMatrix:
        """A matrix of (chunk_id, vector) rows below ``path`` (by default a new shared folder)."""
        spark = vectors.sparkSession
        ship(spark)
        rows = _usable(vectors, id_col, vector_col)
        # The sample is bounded: rows with the smallest hashes of their ids.
        picked = rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE).select("vector").collect()
        sample = [r.vector for r in picked if len(r.vector) == len(picked[0].vector)]
        x = np.array(sample, np.float64).reshape(len(sample), len(sample[0]) if sample else 0)
        x = x[np.linalg.norm(x, axis=1) >= TINY]
        cells = cells or max(1, min(CELLS, int(math.sqrt(len(x)) * 2)))
        centroids = fit_centroids(x / np.linalg.norm(x, axis=1, keepdims=True), cells).tolist() if len(x) else []
        new = cls(spark, path or fresh_path(spark, "vector-matrix"), centroids)
        return new._with(rows, 0)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorMatrix:
        """The newest version in a folder."""
        found = spark.read.text(f"{path}/versions/*").orderBy(F.desc(F.get_json_object("value", "$.version").cast("long"))).first()
        return cls(spark, path, **json.loads(found["value"]))

    def append(self, vectors: DataFrame, id_col: str = "chunk_id", vector_col: str = "vector") -> VectorMatrix:
        """The next version, with more rows; a row whose id is there takes its place."""
        if not self.centroids:
            return VectorMatrix.create(vectors, None, f"{self.path}/{uuid.uuid4().hex}", id_col, vector_col)
        return self._with(_usable(vectors, id_col, vector_col), len(self.folders))

    def delete(self, ids: DataFrame, id_col: str = "chunk_id") -> VectorMatrix:
        """The next version, without some ids."""
        name = f"{self.version + 1:09d}-{uuid.uuid4().hex[:12]}"
        ids.select(F.col(id_col).cast("long").alias("gone"), F.lit(len(self.folders)).alias("before")).distinct().write.parquet(f"{self.path}/deleted/{name}")
        return self._published(self.folders, [*self.deleted, name])

    def compact(self) -> VectorMatrix:
        """The next version, with all live rows in one folder."""
        name = f"{self.version + 1:09d}-{uuid.uuid4().hex[:12]}"
        self._live(self._rows()).withColumn("number", F.lit(0)).drop("folder").hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{self.path}/rows/folder={name}")
        return self._published([name], [])

    def _with(self, rows: DataFrame, number: int) -> VectorMatrix:
        centroids = self.spark.sparkContext.broadcast(np.array(self.centroids))  # cells and dimensions, both bounded

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from stratalore.operators.vector_matrix import encoded

            centers = centroids.value
            for b in batches:
                lists = b.column(1)
                if not len(centers):
                    continue
                right = pc.equal(pc.list_value_length(lists), centers.shape[1])
                b = b.filter(right)
                x = b.column(1).flatten().to_numpy().reshape(b.num_rows, centers.shape[1])
                length = np.linalg.norm(x, axis=1)
                some = np.flatnonzero(length >= 1e-9)
                x, length, b = x[some], length[some], b.take(pa.array(some))
                codes, scale, offset = encoded(x)
                stand = np.linalg.norm(codes * scale[:, None] + offset[:, None], axis=1)
                cell = np.argmax(x @ centers.T, axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale), pa.array(offset), pa.array(codes.sum(axis=1, dtype=np.int64)), pa.array(stand), b.column(1), pa.array(np.full(len(some), number, np.int32)), pa.array(cell)],
                    ["chunk_id", "codes", "scale", "offset", "total", "length", "vector", "number", "cell"],
                )

        name = f"{self.version + 1:09d}-{uuid.uuid4().hex[:12]}"
        rows.mapInArrow(run, f"{_ROWS}, cell int").hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{self.path}/rows/folder={name}")
        return self._published([*self.folders, name], self.deleted)

    def _published(self, folders: list[str], deleted: list[str]) -> VectorMatrix:
        """Written last, and an error if another writer has published that version."""
        saved = {"centroids": self.centroids, "version": self.version + 1, "folders": folders, "deleted": deleted}
        self.spark.createDataFrame([(json.dumps(saved),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{self.path}/versions/{saved['version']:09d}")
        return VectorMatrix(self.spark, self.path, **saved)

    def _rows(self, cells: list[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/rows/folder={f}" for f in self.folders]
        if not self.centroids:
            return self.spark.createDataFrame([], f"{_ROWS}, cell int")
        rows = self.spark.read.schema(f"{_ROWS}, cell int, folder string").option("basePath", f"{self.path}/rows").parquet(*paths)
        return rows if cells is None else rows.where(F.col("cell").isin(cells))

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows that neither a deletion nor a later row of their id has overtaken."""
        if len(self.folders) > 1:
            # A row that takes another's place may lie in another cell: only the ids of later folders are looked at, in all cells.
            later = self._rows().where("number > 0").select(F.col("chunk_id").alias("new_id"), F.col("number").alias("by")).groupBy("new_id").agg(F.max("by").alias("by"))
            rows = rows.join(later, (F.col("chunk_id") == F.col("new_id")) & (F.col("number") < F.col("by")), "left_anti")
        if self.deleted:
            gone = self.spark.read.schema("gone long, before int").parquet(*[f"{self.path}/deleted/{n}" for n in self.deleted]).groupBy("gone").agg(F.max("before").alias("before"))
            rows = rows.join(gone, (F.col("chunk_id") == F.col("gone")) & (F.col("number") < F.col("before")), "left_anti")
        return rows

    @property
    def vectors(self) -> DataFrame:
        """(chunk_id, vector) of the live rows."""
        return self._live(self._rows()).select("chunk_id", "vector")

    def nearest_cells(self, query: list[float], n: int) -> list[int]:
        near = np.array(self.centroids) @ np.array(query, np.float64)
        return sorted(np.argsort(-near, kind="stable")[:n].tolist())

    def search(self, query: list[float], top_k: int = 10, cells: int | None = None) -> DataFrame:
        """(chunk_id, score) by cosine, best first; with ``cells`` only that many cells are opened, without all are read exactly."""
        if not self.centroids or len(query) != len(self.centroids[0]) or math.sqrt(sum(x * x for x in query)) < TINY:
            return self.spark.createDataFrame([], "chunk_id long, score double")
        exact = F.coalesce(cosine_to(F.col("vector"), query), F.lit(0.0)).alias("score")
        if cells is None:
            return self._live(self._rows()).select("chunk_id", exact).orderBy(F.desc("score"), "chunk_id").limit(top_k)
        opened = self.nearest_cells(query, cells)
        asked = np.array(query, np.float64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from stratalore.operators.vector_matrix import code_scores

            for b in batches:
                codes = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, len(asked))
                scores = code_scores(codes, *(b.column(i).to_numpy() for i in range(2, 6)), asked)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores), b.column(6)], ["chunk_id", "rough", "number"])

        rough = self._rows(opened).select("chunk_id", "codes", "scale", "offset", "total", "length", "number").mapInArrow(run, "chunk_id long, rough double, number int")
        best = self._live(rough).orderBy(F.desc("rough"), "chunk_id").limit(AGAIN * top_k).select(F.col("chunk_id").alias("of"), F.col("number").alias("at"))
        # A top-k result: a few rows.
        again = self._rows(opened).join(F.broadcast(best), (F.col("chunk_id") == F.col("of")) & (F.col("number") == F.col("at")))
        return again.select("chunk_id", exact).orderBy(F.desc("score"), "chunk_id").limit(top_k)


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite & (F.size(vector) > 0)).select(F.col(id_col).cast("long").alias("chunk_id"), vector.alias("vector"))
