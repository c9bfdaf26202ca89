"""Reading plain files and ZIP archives as DataFrames.

Files are read with ``binaryFile``, so any store that Spark reads will do. A ZIP is
one row of bytes that becomes one row for each entry, next to its data.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalore.functions.text import extension, file_kind
from stratalore.session import ship

# Media extensions.
PHOTO = ["jpg", "jpeg", "png", "gif", "webp", "bmp", "heic", "heif"]
VIDEO = ["mp4", "mov", "avi", "mkv", "webm", "m4v"]
AUDIO = ["mp3", "m4a", "wav", "aac", "ogg", "flac"]

CHATGPT_NODE = "struct<message:struct<author:struct<role:string>,content:struct<parts:array<string>,text:string>,create_time:double>>"
CHATGPT = f"array<struct<id:string,title:string,create_time:double,update_time:double,mapping:map<string,{CHATGPT_NODE}>>>"


def media_type(path: Column) -> Column:
    ext = extension(path)
    return F.when(ext.isin(PHOTO), "photo").when(ext.isin(VIDEO), "video").when(ext.isin(AUDIO), "audio").otherwise("unknown")


def is_media(path: Column) -> Column:
    return extension(path).isin(PHOTO + VIDEO + AUDIO)


def read_binary(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, modified, size, content) of the files below a folder."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")


def list_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, filename, size, modified) of files in all folders, newest first; contents are not read."""
    out = None
    for p in paths:
        part = read_binary(spark, p).select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "size", "modified")
        out = part if out is None else out.unionByName(part)
    return out.orderBy(F.desc("modified"), "path")


def new_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that the manifest (path, modified) does not have in this state."""
    return files.join(manifest.select("path", "modified"), ["path", "modified"], "left_anti")


def chatgpt_text(raw: Column) -> Column:
    """Titles and "[role]: part" lines of a conversations export; null if the text is none."""
    convs = F.from_json(raw, CHATGPT)

    def lines(c: Column) -> Column:
        def of_node(n: Column) -> Column:
            role = F.coalesce(n["message"]["author"]["role"], F.lit("unknown"))
            parts = F.filter(F.coalesce(n["message"]["content"]["parts"], F.array().cast("array<string>")), lambda p: p.isNotNull() & (p != ""))
            return F.transform(parts, lambda p: F.concat(F.lit("["), role, F.lit("]: "), p))

        title = F.when(c["title"].isNotNull(), F.array(F.concat(F.lit("# "), c["title"]))).otherwise(F.array().cast("array<string>"))
        return F.concat(title, F.flatten(F.transform(F.map_values(F.coalesce(c["mapping"], F.create_map().cast(f"map<string,{CHATGPT_NODE}>"))), of_node)))

    joined = F.array_join(F.flatten(F.transform(convs, lines)), "\n\n")
    return F.when(F.ltrim(raw).startswith("[") & (joined != ""), joined)


def extract_text(files: DataFrame) -> DataFrame:
    """(path, kind, text): text of text files, of chat exports in JSON, and of unknown files that look like text.

    PDF, bytes that are not UTF-8 and files with over a tenth of control
    characters have a null text.
    """
    kind = file_kind(F.col("path"))
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    controls = F.char_length(text) - F.char_length(F.regexp_replace(text, r"[\p{Cc}&&[^\n\r\t]]", ""))
    guarded = F.when(controls <= F.floor(F.octet_length(text) / 10), text)
    out = F.when(kind == "pdf", None).when(kind == "json", F.coalesce(chatgpt_text(text), text)).when(kind == "unknown", guarded).otherwise(text)
    return files.select("path", kind.alias("kind"), out.alias("text"))


def zip_entries(archives: DataFrame) -> DataFrame:
    """(path, entry, size, content) of every file in ZIP archives; what is no ZIP has one row with a null entry."""
    ship(archives.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("entry", pa.string()), ("size", pa.int64()), ("content", pa.binary())])
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content or b""))
                except zipfile.BadZipFile:
                    yield pa.RecordBatch.from_pylist([{"path": path}], schema)
                    continue
                for info in archive.infolist():
                    if not info.is_dir():
                        yield pa.RecordBatch.from_pylist([{"path": path, "entry": info.filename, "size": info.file_size, "content": archive.read(info)}], schema)

    return archives.select("path", "content").mapInArrow(run, "path string, entry string, size long, content binary")
