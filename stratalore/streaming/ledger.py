"""A ledger of hashes that a stream has taken, from which a batch opens little.

The hashes of each batch lie in folders by bucket, the first digits of the hash. A batch
looks only into the buckets that its own hashes fall in. After every ``COMPACT`` batches
all that came before is put together, so that a bucket is a few files however long the
stream has run. Folders are named by batch numbers alone: a batch that is repeated reads
what it read the first time and overwrites what it wrote.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Batches between two compactions; digits of a hash (hexadecimal) that name its bucket.
COMPACT, DIGITS = 16, 2
_SCHEMA = "content_hash string, bucket string"


@dataclass
class HashLedger:
    spark: SparkSession
    path: str

    @staticmethod
    def bucket(of: Column) -> Column:
        # A letter keeps Spark from reading names of folders as numbers.
        return F.concat(F.lit("h"), F.left(of, F.lit(DIGITS)))

    def folders(self, batch: int) -> list[str]:
        """What the batches before ``batch`` have left: the last compacted folder and those after it."""
        base = batch // COMPACT * COMPACT
        return ([f"{self.path}/upto={base}"] if base else []) + [f"{self.path}/batch={n}" for n in range(base, batch)]

    def known(self, batch: int, hashes: DataFrame) -> DataFrame:
        """(content_hash) of earlier batches, from the buckets of ``hashes`` (content_hash) only; at most 16^DIGITS names come to the driver."""
        return self._read(self.folders(batch), [r.b for r in hashes.select(self.bucket(F.col("content_hash")).alias("b")).distinct().collect()])

    def _read(self, folders: list[str], buckets: list[str] | None = None) -> DataFrame:
        parts = [self.spark.read.schema(_SCHEMA).parquet(f) for f in folders]
        if not parts:
            return self.spark.createDataFrame([], "content_hash string")
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        return (rows if buckets is None else rows.where(F.col("bucket").isin(buckets))).select("content_hash")

    def add(self, batch: int, hashes: DataFrame) -> None:
        """The hashes that a batch has taken."""
        self._write(hashes, f"{self.path}/batch={batch}")
        if (batch + 1) % COMPACT == 0:
            self._write(self._read([*self.folders(batch), f"{self.path}/batch={batch}"]), f"{self.path}/upto={batch + 1}")

    def _write(self, hashes: DataFrame, target: str) -> None:
        rows = hashes.select("content_hash", self.bucket(F.col("content_hash")).alias("bucket"))
        rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
