"""WARC archives as a PySpark Python data source.

Writing: every task writes one archive, one gzip member for each record; the
member says its own length in a gzip extra field, so a reader can pass over it
without inflating it. Files get their names when the job commits.

Reading: archives are planned as byte ranges of files; a range starts at the
first member found in it. Filters on record type and on header columns are pushed
down. A record's headers are inflated first; its payload is inflated only if the
headers pass and the schema has the ``payload`` or ``computed_digest`` column.

A payload may be an archive itself, so no range trusts bytes that only look like a
record. The writer keeps the head of its members out of their bodies, so ranges of
its files start at that head. In files that start with a gzip member of another
tool no such mark exists; the first range reads them whole. In uncompressed files a
range passes from record to record by their lengths, reading heads only.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from stratalore.llm.files import list_files, open_file, remove, rename, write_file
from stratalore.llm.places import Placed
from stratalore.session import bound_batches, fresh_path, materialize, ship

SCHEMA = "record_id string, record_type string, date string, target_uri string, refers_to string, payload_digest string, content_length long, payload_bytes long, headers map<string,string>, payload binary, computed_digest string"
#: Bytes of a file in one read partition.
SPLIT_BYTES = 64 << 20
#: Bytes and records in one batch from a reader.
BATCH_BYTES, BATCH_RECORDS = 8 << 20, 1000
_READ = 256 << 10
#: Bytes read at once where only heads of uncompressed records are looked at.
_READ_HEAD = 16 << 10
#: First bytes of a member of this module: gzip head and the head of the extra field "WL".
_MARK = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x08\0WL\x04\0"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"
#: Header columns: name in the schema and in the record.
_HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "date": "warc-date", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to"}


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def _deflate(data: bytes, level: int, cuts: list[int]) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    parts = []
    for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True):
        parts += [z.compress(data[a:b]), z.flush(zlib.Z_SYNC_FLUSH if b < len(data) else zlib.Z_FINISH)]
    return b"".join(parts)


def member(head: bytes, payload: bytes, level: int = 6) -> bytes:
    """One gzip member whose extra field "WL" holds the length of the whole member.

    Data that deflate stores as they are may hold ``_MARK``; they are cut inside it.
    """
    data = head + payload
    end = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    cuts: set[int] = set()
    for pieces in range(1, len(data) + 2):
        body = _deflate(data, level, sorted(cuts - {0, len(data)}))
        rest = struct.pack("<I", len(_MARK) + 4 + len(body) + len(end)) + body + end
        if _MARK not in rest:
            return _MARK + rest
        cuts |= {m.start() + 8 for m in re.finditer(re.escape(_MARK), data)} | {len(data) * k // pieces for k in range(1, pieces)}
    raise ValueError("a record cannot be told from the members around it")


def record(record_id: str, kind: str, uri: str | None, digest: str, refers_to: str | None, payload: bytes, payload_bytes: int) -> tuple[bytes, bytes]:
    """Head (WARC and HTTP headers) and tail (payload and closing lines) of a record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {_DATE}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {_clean(uri)}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {_PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + http, payload + b"\r\n\r\n"


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Rows of record_id, record_type, target_uri, payload_digest (hex SHA-1), refers_to, payload_bytes, payload."""

    def __init__(self, path: str, level: int):
        self.path, self.level = path.rstrip("/"), level

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        def members():
            for batch in iterator:
                for r in batch.to_pylist():
                    head, tail = record(r["record_id"], r["record_type"], r["target_uri"], base64.b32encode(bytes.fromhex(r["payload_digest"])).decode(), r["refers_to"], r["payload"] or b"", r["payload_bytes"])
                    yield member(head, tail, self.level)

        name = f"{self.path}/_pending-{uuid.uuid4().hex}"
        if write_file(name, members()):
            return _Written([name])
        remove(name)
        return _Written([])

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        for i, m in enumerate(messages):
            for name in m.names if m else ():
                rename(name, f"{self.path}/part-{i:06d}-{name[-32:]}.warc.gz")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for m in messages:
            for name in m.names if m else ():
                remove(name)


@dataclass
class _Range(InputPartition):
    uri: str
    start: int
    end: int
    size: int


class _Buffered:
    """Forward reads at any offset of a file through one buffer."""

    def __init__(self, f, size: int, read: int = _READ):
        self.f, self.size, self.read, self.at, self.data = f, size, read, 0, b""

    def get(self, offset: int, n: int) -> bytes:
        if offset < self.at or offset + n > self.at + len(self.data):
            self.f.seek(offset)
            self.at, self.data = offset, self.f.read(max(n, self.read))
        k = offset - self.at
        return self.data[k : k + n]


def _parse(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


class _Inflating:
    """A gzip member read little by little; ``end`` is the offset after it once it is read to its end."""

    def __init__(self, source: _Buffered, at: int):
        self.source, self.at, self.z, self.out = source, at, zlib.decompressobj(31), b""

    @property
    def end(self) -> int:
        while not self.z.eof and self.more(drop=True):
            pass
        return self.at - len(self.z.unused_data)

    def more(self, drop: bool = False, n: int = 4096) -> bool:
        if self.z.eof:
            return False
        feed = self.z.unconsumed_tail
        if not feed:
            feed = self.source.get(self.at, 64 << 10)
            self.at += len(feed)
            if not feed:
                raise EOFError("an archive ends inside a record")
        got = self.z.decompress(feed, n if not drop else 1 << 20)
        if not drop:
            self.out += got
        return True

    def head(self) -> tuple[int, dict[str, str], int]:
        """Length of the record's head, its headers and the length of what follows."""
        size = self.until(b"\r\n\r\n", 0)
        if size < 0:
            raise ValueError("a record without the end of its headers")
        headers = _parse(self.out[: size - 4])
        return size, headers, int(headers.get("content-length", 0))

    def until(self, mark: bytes, start: int) -> int:
        """Offset after the next ``mark``, or -1."""
        at = start
        while (k := self.out.find(mark, max(start, at - len(mark)))) < 0:
            at = len(self.out)
            if not self.more():
                return -1
        return k + len(mark)

    def upto(self, n: int) -> bytes:
        parts = [self.out]
        have = len(self.out)
        while have < n:
            self.out = b""
            if not self.more(n=1 << 20):
                break
            parts.append(self.out)
            have += len(self.out)
        self.out = b"".join(parts)
        return self.out


class _Plain(_Inflating):
    """An uncompressed record with the same reads."""

    def __init__(self, source: _Buffered, at: int):
        self.source, self.at, self.start, self.out = source, at, at, b""

    @property
    def end(self) -> int:
        size, _, length = self.head()
        return self.start + size + length + 4

    def more(self, drop: bool = False, n: int = 4096) -> bool:
        got = self.source.get(self.at, n)
        self.at += len(got)
        self.out += got
        return bool(got)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, split: int):
        self.path, self.fields, self.split = path, schema.fieldNames(), split
        self.wanted: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            header = name in _HEADERS or name == "payload_digest"
            if header and isinstance(f, EqualTo) and isinstance(f.value, str):
                self.wanted.append((name, "in", (f.value,)))
            elif header and isinstance(f, In) and all(isinstance(x, str) for x in f.value):
                self.wanted.append((name, "in", tuple(f.value)))
            elif header and isinstance(f, StringStartsWith):
                self.wanted.append((name, "starts", (f.value,)))
            elif header and isinstance(f, IsNotNull):
                self.wanted.append((name, "there", ()))
            else:
                yield f

    def partitions(self):
        out = []
        for uri, size in list_files(self.path):
            name = uri.rsplit("/", 1)[-1]
            if size and not name.startswith(("_", ".")):
                out += [_Range(uri, a, min(a + self.split, size), size) for a in range(0, size, self.split)]
        return out or [_Range("", 0, 0, 0)]

    def _passes(self, row: dict) -> bool:
        for name, how, values in self.wanted:
            x = row[name]
            if x is None or (how == "in" and x not in values) or (how == "starts" and not x.startswith(values)):
                return False
        return True

    @staticmethod
    def _first(source: _Buffered, part: _Range) -> int:
        """Offset of the first record that this range reads, or the end of the file."""
        if part.start == 0:
            return 0
        start = source.get(0, len(_MARK))
        if start[:2] != _MARK[:2]:
            heads, at = _Buffered(source.f, part.size, _READ_HEAD), 0
            while at < part.start:
                at = _Plain(heads, at).end if heads.get(at, 5) == b"WARC/" else at + 1
            return at
        at = part.start if start == _MARK else part.end
        while at < part.end:
            block = source.get(at, min(_READ, part.end - at + len(_MARK) - 1))
            if (k := block.find(_MARK)) >= 0:
                return at + k
            at += max(1, len(block) - len(_MARK) + 1)
        return part.size

    @staticmethod
    def _goes_on(source: _Buffered, part: _Range, at: int) -> bool:
        """Whether the record at ``at`` is this range's; those of gzip files beyond its end are, up to the next with a mark in a marked file."""
        if at < part.end or at >= part.size:
            return at < part.end
        start = source.get(0, len(_MARK))
        return start[:2] == _MARK[:2] and (start != _MARK or source.get(at, len(_MARK)) != _MARK)

    def records(self, part: _Range) -> Iterator[dict]:
        inside = "payload" in self.fields or "computed_digest" in self.fields
        with open_file(part.uri) as f:
            source = _Buffered(f, part.size)
            at = self._first(source, part)
            while self._goes_on(source, part, at):
                start = source.get(at, 20)
                packed = start[:2] == b"\x1f\x8b"
                if not packed and start[:5] != b"WARC/":
                    at += 1  # padding between records
                    continue
                known = struct.unpack("<I", start[16:20])[0] if len(start) == 20 and start.startswith(_MARK) else None
                body = (_Inflating if packed else _Plain)(source, at)
                head_end, headers, length = body.head()
                row = {name: headers.get(key) for name, key in _HEADERS.items()}
                row["payload_digest"] = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
                row["content_length"] = length
                row["headers"] = headers
                if self._passes(row):
                    http_end, http = head_end, {}
                    if length and headers.get("content-type", "").startswith("application/http"):
                        http_end = body.until(b"\r\n\r\n", head_end)
                        http_end = http_end if 0 <= http_end <= head_end + length else head_end + length
                        http = _parse(body.out[head_end:http_end])
                    there = head_end + length - http_end
                    payload = body.upto(head_end + length)[http_end : head_end + length] if inside else None
                    if inside and len(payload) != there:
                        raise EOFError(f"{part.uri}: the record at {at} ends early")
                    declared = http.get("content-length", "")
                    row["payload_bytes"] = int(declared) if row["record_type"] == "revisit" and declared.isdigit() else there
                    row["payload"] = payload
                    row["computed_digest"] = base64.b32encode(hashlib.sha1(payload).digest()).decode() if "computed_digest" in self.fields else None
                    yield row
                at = at + known if known else body.end

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        types = {"content_length": pa.int64(), "payload_bytes": pa.int64(), "headers": pa.map_(pa.string(), pa.string()), "payload": pa.binary()}

        def batch(rows):
            cols = [pa.array([list(r[c].items()) if c == "headers" else r[c] for r in rows], types.get(c, pa.string())) for c in self.fields]
            return pa.RecordBatch.from_arrays(cols, self.fields)

        rows, size = [], 0
        for row in self.records(partition) if partition.uri else ():
            rows.append(row)
            size += len(row["payload"] or b"") + 500
            if "payload" not in self.fields:
                row["payload"] = None
            if len(rows) >= BATCH_RECORDS or size >= BATCH_BYTES:
                yield batch(rows)
                rows, size = [], 0
        if rows:
            yield batch(rows)


class WarcSource(DataSource):
    """Options: path; split (bytes of a read partition); level (gzip level when writing)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema, int(self.options.get("split", SPLIT_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        if overwrite:
            for uri, _ in list_files(self.options["path"]):
                remove(uri)
        return WarcWriter(self.options["path"], int(self.options.get("level", 1)))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_warc(spark: SparkSession, path: str, columns: list[str] | None = None, **options) -> DataFrame:
    """Records of the archives at ``path`` with the given columns (all by default); payloads only if named."""
    register(spark)
    schema = StructType.fromDDL(SCHEMA)
    picked = StructType([schema[c] for c in columns or schema.fieldNames()])
    return spark.read.format("warc").schema(picked).options(**options).load(path)


def as_records(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Record rows of pages; of equal payloads of ``min_bytes`` or more the smallest id is the response, others revisit it.

    A null html is an empty payload. Repeated rows with the smallest id are all
    responses. A null id is never the smallest unless all ids of that payload are
    null; then all are responses. Other columns are left out. Roles are decided on
    narrow rows; payloads stay where they lie and go straight into archives.
    """
    placed = Placed.of(pages)
    text = lambda df: F.coalesce(df[html_col].cast("string"), F.lit(""))
    facts = lambda df: [df[id_col].cast("long").alias("page_id"), df[url_col].cast("string").alias("target_uri"), F.sha1(text(df)).alias("payload_digest"), F.octet_length(text(df)).cast("long").alias("payload_bytes")]
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    row = lambda kind, refers_to, payload: [name(F.col("page_id")).alias("record_id"), F.lit(kind).alias("record_type"), F.col("target_uri"), F.col("payload_digest"), refers_to.cast("string").alias("refers_to"), F.col("payload_bytes"), payload.cast("binary").alias("payload")]
    rows = materialize(placed.df.select(*placed.place, *facts(placed.df)), "warc-pages")
    shared = materialize(rows.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1 and first is not null").drop("n"), "warc-shared")
    roles = materialize(rows.join(shared, ["payload_digest", "payload_bytes"], "left").withColumn("revisit", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))), "warc-roles")
    full = placed.only(roles.where("not revisit"), [*dict.fromkeys([id_col, url_col, html_col])])
    responses = full.select(*facts(full), F.encode(text(full), "UTF-8").alias("html")).select(*row("response", F.lit(None), F.col("html")))
    return responses.unionByName(roles.where("revisit").select(*row("revisit", name(F.col("first")), F.lit(None))))


def write_warc(pages: DataFrame, path: str, **options) -> None:
    """Write pages as archives below ``path`` (a shared folder)."""
    register(pages.sparkSession)
    bound_batches(pages.sparkSession, 1000)
    as_records(pages, **options).write.format("warc").mode("append").save(path)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write the pages as archives in the shared folder and read them back, one row for each record.

    Size and digest of a response are those of its payload as read; a revisit has none and gives its headers.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_warc(pages, path)
    number = lambda c: F.nullif(F.regexp_extract(c, "^<urn:x-page:(-?[0-9]*)>$", 1), F.lit("")).cast("long")
    found = read_warc(spark, path, ["record_id", "record_type", "refers_to", "payload_digest", "payload_bytes", "computed_digest"])
    found = found.where(F.col("record_type").isin("response", "revisit"))
    return found.select(number("record_id").alias("page_id"), "payload_bytes", F.when(F.col("record_type") == "response", F.col("computed_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))
