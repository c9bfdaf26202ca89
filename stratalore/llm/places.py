"""Rows named by their place in Parquet files, and a choice of rows applied where they lie.

A row's place is its file (16 bytes that stand for the path) and its number in the
file. A choice of rows is written as one short list for each file and ``SPAN`` rows
of it, also where no row is kept; each task then reads the lists of the rows that it
scans, and fails if one is missing. So a filter
that is decided elsewhere reaches wide rows without a shuffle of them, and no task
holds more than one bit for each row of a span.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalore.llm.files import read_file, write_file
from stratalore.session import bound_batches, fresh_path, materialize, parquet_scan, ship, shuffle_partitions

#: Rows of a file that one list covers: at most 128 kB of bits.
SPAN = 1 << 20


def _list_name(path: str, file: bytes, span: int) -> str:
    return f"{path}/{file.hex()}-{span}.bits"


@dataclass
class Placed:
    """Rows of Parquet files (``df``) and the columns (file binary, row long) of their places."""

    df: DataFrame
    place: list[Column]

    @classmethod
    def of(cls, df: DataFrame) -> Placed:
        """Places of the rows of ``df``, which is written to the shared folder first unless it is a plain scan of Parquet files."""
        if not parquet_scan(df):
            df = materialize(df, "placed-rows")
        meta = df.metadataColumn("_metadata")
        return cls(df, [F.unhex(F.md5(meta["file_path"])).alias("file"), meta["row_index"].alias("row")])

    def only(self, kept: DataFrame, columns: list[str] | None = None) -> DataFrame:
        """The rows at the places ``kept`` (file, row), with the columns of ``df`` or those named."""
        spark, path = self.df.sparkSession, fresh_path(self.df.sparkSession, "kept-rows")
        ship(spark)
        bound_batches(spark)

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            file, span, rows = None, None, []

            def flush():
                inside = np.concatenate(rows) - span * SPAN
                bits = np.zeros(int(inside.max(initial=-1)) + 1, bool)
                bits[inside] = True
                write_file(_list_name(path, file, span), [np.packbits(bits, bitorder="little").tobytes()])
                return pa.RecordBatch.from_arrays([pa.array([file], pa.binary()), pa.array([span], pa.int64())], ["file", "span"])

            for b in batches:
                files, spans, row, real = b.column(0).to_pylist(), b.column(1).to_numpy(), b.column(2).fill_null(0).to_numpy(), b.column(2).is_valid().to_numpy(zero_copy_only=False)
                edges = [k for k in range(len(files)) if not k or files[k] != files[k - 1] or spans[k] != spans[k - 1]]
                for a, z in zip(edges, [*edges[1:], len(files)], strict=True):
                    if rows and (files[a], spans[a]) != (file, span):
                        yield flush()
                        rows = []
                    file, span = files[a], int(spans[a])
                    rows.append(row[a:z][real[a:z]])
            if rows:
                yield flush()

        span = F.floor(F.col("row") / SPAN).alias("span")
        # Every span of the scan gets a list, if only an empty one: so a list that is missing later is lost, and an error.
        spans = self.df.select(*self.place).select("file", span).distinct().withColumn("row", F.lit(None).cast("long"))
        dealt = kept.select("file", span, "row").unionByName(spans).repartition(shuffle_partitions(spark), "file", "span").sortWithinPartitions("file", "span")
        # Written to the end before any list is read.
        materialize(dealt.mapInArrow(write, "file binary, span long"), "kept-lists")
        columns = columns or self.df.columns
        schema = self.df.select(*[self.df[c] for c in columns]).schema

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict = {}
            for b in batches:
                row = b.column(1).to_numpy()
                files = b.column(0).dictionary_encode()
                code, span = files.indices.to_numpy(), row // SPAN
                keep = np.zeros(len(row), bool)
                for c, s in {*zip(code.tolist(), span.tolist(), strict=True)}:
                    key = files.dictionary[c].as_py(), s
                    if key not in held:
                        if len(held) > 64:
                            held.clear()
                        held[key] = _bits(_list_name(path, *key))
                    at = np.flatnonzero((code == c) & (span == s))
                    inside = row[at] - s * SPAN
                    at, inside = at[inside < len(held[key])], inside[inside < len(held[key])]
                    keep[at] = held[key][inside]
                if keep.any():
                    yield pa.RecordBatch.from_arrays(b.column(2).filter(pa.array(keep)).flatten(), columns)

        whole = F.struct(*[self.df[c] for c in columns]).alias("doc")
        return self.df.select(*self.place, whole).mapInArrow(pick, schema)


def _bits(name: str) -> np.ndarray:
    """The list in a file, up to its last kept row."""
    return np.unpackbits(np.frombuffer(read_file(name), np.uint8), bitorder="little").view(bool)
