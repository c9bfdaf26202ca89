"""Pages of a sorted table by a written directory, and work on pending rows that goes on where it stopped."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalore.session import fresh_path


@dataclass
class PageDirectory:
    """A table in ranges of its order, each in a folder, and the rows of each and before it.

    A page opens the one or two ranges that it lies in, however deep it is. Rows are
    ordered by ``by`` and ``key`` (both descending unless ``ascending``), nulls as Spark
    orders them. The directory is of the table as it was; a changed table needs a new one.
    """

    spark: SparkSession
    path: str
    order: list[tuple[str, bool]]
    ranges: list[tuple[int, int, int]]

    @classmethod
    def create(cls, table: DataFrame, by: str = "created_at", key: str = "id", ascending: bool = False, path: str | None = None, ranges: int | None = None) -> PageDirectory:
        spark = table.sparkSession
        path, order = path or fresh_path(spark, "pages"), [(by, ascending), (key, ascending)]
        dealt = table.repartitionByRange(*([ranges] if ranges else []), *cls._columns(order))
        dealt.sortWithinPartitions(*cls._columns(order)).withColumn("_range", F.spark_partition_id()).write.partitionBy("_range").parquet(path)
        # One row for each range comes to the driver.
        counts = {} if table.isEmpty() else {r["_range"]: r["n"] for r in spark.read.parquet(path).groupBy("_range").agg(F.count("*").alias("n")).collect()}
        before, found = 0, []
        for k in sorted(counts):
            found.append((k, before, counts[k]))
            before += counts[k]
        return cls(spark, path, order, found)

    @staticmethod
    def _columns(order: list[tuple[str, bool]]) -> list[Column]:
        return [F.col(c).asc() if up else F.col(c).desc() for c, up in order]

    @property
    def total(self) -> int:
        return sum(n for *_, n in self.ranges)

    def pages(self, size: int = 10) -> int:
        return -(-self.total // size)

    def opened(self, number: int, size: int = 10) -> list[tuple[int, int]]:
        """Ranges that hold rows of a page, and the rows before each."""
        first = max(0, number - 1) * size
        return [(k, b) for k, b, n in self.ranges if b < first + size and first < b + n]

    def page(self, number: int, size: int = 10) -> DataFrame | None:
        """Page ``number``, counted from 1, in order; None of a table without rows."""
        if not self.ranges:
            return None
        first, opened = max(0, number - 1) * size, self.opened(number, size)
        rows = self.spark.read.parquet(self.path).where(F.col("_range").isin([k for k, _ in opened])).drop("_range")
        return rows.orderBy(*self._columns(self.order)).offset(first - min([b for _, b in opened], default=first)).limit(size)


def catch_up(pending: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], path: str, size: int = 50, batches: int | None = None) -> int:
    """Work on pending rows in batches by key; results go to ``path``/results, one folder for each batch. Returns the batches done.

    What is done is known from the results alone: each batch takes the ``size`` smallest
    keys that no result has, so a run that was stopped goes on with the next one, rows
    that come later are not starved by newer ones, and a batch that failed half way is
    done again from its beginning. ``work`` must keep the key column, one row a key.
    Rows with a null key are left out; keys that repeat are worked on together.
    """
    spark, done = pending.sparkSession, 0
    schema = work(pending.limit(0)).schema
    while batches is None or done < batches:
        try:
            known = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/results").select(key).distinct()
            left = pending.join(known, key, "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            left = pending
        keys = left.where(F.col(key).isNotNull()).select(key).distinct().orderBy(key).limit(size)
        chosen = [r[0] for r in keys.collect()]
        if not chosen:
            break
        work(pending.where(F.col(key).isin(chosen))).write.mode("overwrite").parquet(f"{path}/results/from-{chosen[0]}")
        done += 1
    return done
