"""ZIP archives as a partitioned source and sink.

Reading plans partitions by bytes. Archives up to a partition's size are put together
unopened; a larger one has its central directory read once, and its entries are cut
into runs, so that one archive is read by many tasks and each seeks to its own entries.
A run knows where its part of the directory lies, so a task parses that part only.
Tests of entry names and sizes that the query makes are pushed into the reader: what
fails them is never unpacked, and contents are unpacked only if the column is asked for.
A task holds one entry at a time beside a batch of bounded size.

Writing puts the entries of each task into one archive, which appears when the whole
write has succeeded.

Defined results: an archive that can't be opened has one row with a null entry and an
error; an entry that is encrypted, damaged, packed in an unknown way or larger than
``limit`` has null content and an error; folders are no entries; an empty archive has no
rows; entries that share a name are rows of their own; a null name can't be written.
"""

from __future__ import annotations

import io
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from stratalore.session import ship
from stratalore.sources.storage import new_file, open_file, remove, rename, walk_files

SCHEMA = "path string, entry string, size long, content binary, error string"
#: Bytes (packed) of a read partition; bytes of the largest content that becomes a value; bytes and rows of a batch.
SPLIT, LIMIT, BATCH_BYTES, BATCH_ROWS = 64 << 20, 1 << 30, 16 << 20, 1000
_TYPES = {"size": pa.int64(), "content": pa.binary()}
#: What a damaged or unusual archive or entry raises.
_BAD = (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError, OSError, ValueError)

_TESTS: dict[type, Callable] = {
    EqualTo: lambda f: lambda x: x == f.value,
    In: lambda f: lambda x: x in f.value,
    StringStartsWith: lambda f: lambda x: x.startswith(f.value),
    StringEndsWith: lambda f: lambda x: x.endswith(f.value),
    StringContains: lambda f: lambda x: f.value in x,
    GreaterThan: lambda f: lambda x: x > f.value,
    GreaterThanOrEqual: lambda f: lambda x: x >= f.value,
    LessThan: lambda f: lambda x: x < f.value,
    LessThanOrEqual: lambda f: lambda x: x <= f.value,
    IsNotNull: lambda f: lambda x: True,
}


@dataclass
class _Run:
    """Some entries of an archive, by their places in its directory; all of them if ``last`` is None.

    With ``part`` (start of the directory, start and bytes of the run's records in it, bytes
    before the archive proper) only these records are read, and the places are theirs.
    """

    uri: str
    first: int = 0
    last: int | None = None
    part: tuple[int, int, int, int] | None = None


class _Partial(io.RawIOBase):
    """An archive as if its directory had the records of one run only."""

    def __init__(self, f, start: int, at: int, size: int, before: int):
        f.seek(at)
        records, end = f.read(size), start + size
        if len(records) != size or not records.startswith(zipfile.stringCentralDir):
            raise zipfile.BadZipFile("the directory changed")
        # Counts are not looked at by readers that go by bytes; the 64-bit form holds any place.
        self.tail = records + struct.pack("<4sQ2H2L4Q", b"PK\6\6", 44, 45, 45, 0, 0, 0, 0, size, start - before) + struct.pack("<4sLQL", b"PK\6\7", 0, end, 1) + struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
        self.f, self.start, self.at = f, start, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, to: int, whence: int = 0) -> int:
        self.at = max(0, to + (0, self.at, self.start + len(self.tail))[whence])
        return self.at

    def read(self, n: int = -1) -> bytes:
        if self.at < self.start:
            self.f.seek(self.at)
            data = self.f.read(min(n, self.start - self.at) if n >= 0 else self.start - self.at)
        else:
            data = self.tail[self.at - self.start :][: n if n >= 0 else None]
        self.at += len(data)
        return data


def _records(archive: zipfile.ZipFile, f) -> tuple[list[int], int] | None:
    """Where the records of the directory start, its end last, and the bytes before the archive proper; None if that can't be told."""
    infos, ends = archive.infolist(), [archive.start_dir]
    for i in infos:
        ends.append(ends[-1] + zipfile.sizeCentralDir + len(i.orig_filename.encode("utf-8" if i.flag_bits & 0x800 else "cp437")) + len(i.extra) + len(i.comment))
    f.seek(ends[-1])
    if not infos or f.read(4) not in (b"PK\5\6", b"PK\6\6"):
        return None
    f.seek(ends[0] + 42)
    (first,) = struct.unpack("<L", f.read(4))
    return (ends, infos[0].header_offset - first) if first < 0xFFFFFFFF else None


@dataclass
class _Part(InputPartition):
    runs: list[_Run]


def _files(archive: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    return [i for i in archive.infolist() if not i.is_dir()]


def cut(sizes: list[int], split: int) -> list[tuple[int, int]]:
    """Runs of consecutive entries of about ``split`` bytes; a larger entry is a run of its own."""
    runs, first, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > first and total + n > split:
            runs.append((first, i))
            first, total = i, 0
        total += n
    return [*runs, (first, len(sizes))]


class ZipReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, split: int, limit: int, suffixes: tuple[str, ...]):
        self.path, self.fields, self.split, self.limit, self.suffixes = path, schema.fieldNames(), split, limit, suffixes
        self.tests: list[tuple[str, Callable]] = []
        self.pushed: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("entry",), ("size",)) and getattr(f, "value", "") is not None:
                self.pushed.append(f)
            else:
                yield f

    def partitions(self) -> list[_Part]:
        found = [(u, n) for u, n in walk_files(self.path) if u.lower().endswith(self.suffixes)]
        with ThreadPoolExecutor(16) as pool:
            large = [r for runs in pool.map(self._runs, [u for u, n in found if n > self.split]) for r in runs]
        parts = [_Part([r]) for r in large]
        small = [(u, n) for u, n in found if n <= self.split]
        parts += [_Part([_Run(u) for u, _ in small[a:z]]) for a, z in (cut([n for _, n in small], self.split) if small else [])]
        return parts or [_Part([])]

    def _runs(self, uri: str) -> list[_Run]:
        try:
            with open_file(uri) as f, zipfile.ZipFile(f) as archive:
                files = [k for k, i in enumerate(archive.infolist()) if not i.is_dir()]
                runs, known = cut([archive.infolist()[k].compress_size for k in files], self.split), _records(archive, f)
                if known is None or not files:
                    return [_Run(uri, a, z) for a, z in runs]
                ends, before = known
                return [_Run(uri, 0, None, (ends[0], ends[files[a]], ends[files[z - 1] + 1] - ends[files[a]], before)) for a, z in runs]
        except _BAD:
            return [_Run(uri)]

    def rows(self, run: _Run) -> Iterator[dict]:
        tests = [(f.attribute[0], _TESTS[type(f)](f)) for f in self.pushed]
        try:
            with open_file(run.uri) as f, zipfile.ZipFile(_Partial(f, *run.part) if run.part else f) as archive:
                for info in _files(archive)[run.first : run.last]:
                    row = {"path": run.uri, "entry": info.filename, "size": info.file_size, "content": None, "error": None}
                    if all(test(row[name]) for name, test in tests):
                        if "content" in self.fields or "error" in self.fields:
                            row["content"], row["error"] = self._content(archive, info)
                        yield row
        except _BAD as e:
            if not self.pushed:
                yield {"path": run.uri, "entry": None, "size": None, "content": None, "error": f"{type(e).__name__}: {e}"}

    def _content(self, archive: zipfile.ZipFile, info: zipfile.ZipInfo) -> tuple[bytes | None, str | None]:
        try:
            with archive.open(info) as f:
                data = f.read(self.limit + 1)
                if len(data) > self.limit:
                    return None, f"larger than {self.limit} bytes"
                f.read(1)  # the end of an entry checks its sum
                return data, None
        except _BAD as e:
            return None, f"{type(e).__name__}: {e}"

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], _TYPES.get(c, pa.string())) for c in self.fields], self.fields)

        rows, size = [], 0
        for run in partition.runs:
            for row in self.rows(run):
                if rows and size + len(row["content"] or b"") > BATCH_BYTES:
                    yield batch()
                    rows, size = [], 0
                rows.append(row)
                size += len(row["content"] or b"")
                if len(rows) >= BATCH_ROWS:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()


@dataclass
class _Written(WriterCommitMessage):
    name: str | None


class ZipWriter(DataSourceArrowWriter):
    """Rows of (entry, content)."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        name, n = f"{self.path}/_pending-{uuid.uuid4().hex}", 0
        with new_file(name) as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as archive:
            for b in iterator:
                for entry, content in zip(b.column("entry").to_pylist(), b.column("content").to_pylist(), strict=True):
                    archive.writestr(zipfile.ZipInfo(entry, (1980, 1, 1, 0, 0, 0)), content or b"", zipfile.ZIP_DEFLATED)
                    n += 1
        if not n:
            remove(name)
        return _Written(name if n else None)

    def commit(self, messages: list[_Written | None]) -> None:
        for i, m in enumerate(messages):
            if m and m.name:
                rename(m.name, f"{self.path}/archive-{i:06d}-{m.name[-32:]}.zip")

    def abort(self, messages: list[_Written | None]) -> None:
        for m in messages:
            if m and m.name:
                remove(m.name)


class ZipSource(DataSource):
    """Options: path; split, limit (bytes); suffixes of archive names, comma-joined."""

    @classmethod
    def name(cls) -> str:
        return "zip"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ZipReader:
        o = self.options
        return ZipReader(o["path"], schema, int(o.get("split", SPLIT)), int(o.get("limit", LIMIT)), tuple(o.get("suffixes", ".zip").lower().split(",")))

    def writer(self, schema: StructType, overwrite: bool) -> ZipWriter:
        if overwrite:
            for uri, _ in list(walk_files(self.options["path"])):
                remove(uri)
        return ZipWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ZipSource)


def read_zip(spark: SparkSession, path: str, columns: list[str] | None = None, **options) -> DataFrame:
    """Entries of the archives in a folder, below it or at ``path``, with the given columns (all by default); contents are unpacked only if named."""
    register(spark)
    schema = StructType.fromDDL(SCHEMA)
    return spark.read.format("zip").schema(StructType([schema[c] for c in columns or schema.fieldNames()])).options(**options).load(path)


def write_zip(entries: DataFrame, path: str, mode: str = "append") -> None:
    """Write (entry, content) rows as archives below ``path``, one for each task that has rows."""
    register(entries.sparkSession)
    entries.select(entries["entry"].cast("string"), entries["content"].cast("binary")).write.format("zip").mode(mode).save(path)
