import io
import zipfile

import pytest
from pyspark.sql import functions as F

from stratalore.sources import archives as A
from stratalore.sources import connectors as C
from stratalore.sources import storage


def archive(path, entries, method=zipfile.ZIP_DEFLATED):
    path.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w", method) as z:
        for name, data in entries:
            z.writestr(name, data)


def rows(df):
    return sorted((r.path.rsplit("/", 1)[1], r.entry, r.size, bytes(r.content) if r.content is not None else None, r.error) for r in df.collect())


def test_one_archive_is_read_by_several_tasks(spark, tmp_path):
    entries = [(f"d{i % 3}/f{i}.txt", f"{i} ".encode() * 500) for i in range(40)]
    archive(tmp_path / "big.zip", entries, zipfile.ZIP_STORED)
    archive(tmp_path / "below" / "small.ZIP", [("a.txt", b"a"), ("folder/", b""), ("a.txt", b"second")])
    (tmp_path / "notes.txt").write_text("no archive")
    df = A.read_zip(spark, str(tmp_path), split=5000)
    assert df.rdd.getNumPartitions() > 5
    want = sorted([("big.zip", n, len(d), d, None) for n, d in entries] + [("small.ZIP", "a.txt", 1, b"a", None), ("small.ZIP", "a.txt", 6, b"second", None)])
    assert rows(df) == want == rows(A.read_zip(spark, str(tmp_path)))
    one = A.read_zip(spark, str(tmp_path / "big.zip"), ["entry"])
    assert sorted(r.entry for r in one.collect()) == sorted(n for n, _ in entries)
    assert A.read_zip(spark, str(tmp_path / "none")).count() == 0


def test_filters_are_pushed_and_other_entries_stay_packed(spark, tmp_path, monkeypatch):
    archive(tmp_path / "x.zip", [(f"p/{k}.json", b"{}" * k) for k in range(1, 30)] + [(f"media/{k}.mp4", b"v" * 1000) for k in range(5)])
    df = A.read_zip(spark, str(tmp_path)).where(F.col("entry").endswith(".json") & F.col("entry").startswith("p/") & (F.col("size") > 20) & (F.col("size") <= 40) & F.col("entry").contains("/"))
    assert sorted(r.size for r in df.collect()) == list(range(22, 41, 2))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EndsWith(entry" not in plan.split("BatchScan")[0]
    reader = A.ZipReader(str(tmp_path), A.StructType.fromDDL(A.SCHEMA), 1 << 20, 1 << 20, (".zip",))
    opened = []
    monkeypatch.setattr(reader, "_content", lambda z, i: (opened.append(i.filename), (b"", None))[1])
    assert list(reader.pushFilters([A.StringEndsWith(("entry",), "9.json"), A.EqualTo(("path",), "x")])) == [A.EqualTo(("path",), "x")]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 3 and opened == ["p/9.json", "p/19.json", "p/29.json"]


def test_damaged_and_odd_archives(spark, tmp_path):
    (tmp_path / "no.zip").write_bytes(b"no zip at all")
    (tmp_path / "none.zip").write_bytes(b"")
    archive(tmp_path / "empty.zip", [])
    archive(tmp_path / "large.zip", [("l", b"x" * 5000), ("s", b"y")])
    archive(tmp_path / "hurt.zip", [("h", b"abcdefgh" * 50), ("fine", b"ok")], zipfile.ZIP_STORED)
    data = bytearray((tmp_path / "hurt.zip").read_bytes())
    data[40] ^= 255
    (tmp_path / "hurt.zip").write_bytes(bytes(data))
    got = {(r.path.rsplit("/", 1)[1], r.entry): (r.content, r.error) for r in A.read_zip(spark, str(tmp_path), limit=1000).collect()}
    assert set(got) == {("no.zip", None), ("none.zip", None), ("large.zip", "l"), ("large.zip", "s"), ("hurt.zip", "h"), ("hurt.zip", "fine")}
    assert got["large.zip", "l"] == (None, "larger than 1000 bytes") and got["large.zip", "s"] == (bytearray(b"y"), None)
    assert got["hurt.zip", "h"][0] is None and "CRC" in got["hurt.zip", "h"][1] and got["hurt.zip", "fine"] == (bytearray(b"ok"), None)
    assert "BadZipFile" in got["no.zip", None][1]


def test_round_trip_and_failed_writes(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(200).select(F.concat(F.lit("e/"), "id").alias("entry"), F.repeat(F.lit("x"), F.col("id").cast("int")).alias("content"), F.lit(1).alias("size"))
    A.write_zip(df.repartition(3), path)
    back = A.read_zip(spark, path)
    assert {r.entry: len(r.content) for r in back.collect()} == {f"e/{i}": i for i in range(200)} and len(list(storage.walk_files(path))) == 3
    with pytest.raises(Exception, match="boom"):
        A.write_zip(df.withColumn("content", F.when(F.col("entry") == "e/150", F.raise_error("boom").cast("string")).otherwise("")), path)
    assert A.read_zip(spark, path, ["entry"]).count() == 200
    A.write_zip(df.limit(0), path)
    assert A.read_zip(spark, path, ["entry"]).count() == 200
    A.write_zip(df.limit(5), path, "overwrite")
    assert A.read_zip(spark, path, ["entry"]).count() == 5


def test_runs_of_entries():
    assert A.cut([5, 5, 5, 100, 1], 10) == [(0, 2), (2, 3), (3, 4), (4, 5)] and A.cut([], 10) == [(0, 0)]


def test_exports_through_the_source(spark, tmp_path):
    buffer = io.BytesIO(b'[{"id": "c1", "title": "T", "mapping": {"a": {"message": {"author": {"role": "user"}, "content": {"parts": ["hi"]}, "create_time": 1.0}}}}]')
    archive(tmp_path / "g.zip", [("export/conversations.json", buffer.getvalue()), ("xconversations.json", b"[]"), ("m/p.jpg", b"123")])
    conv = C.chatgpt_conversations(A.read_zip(spark, str(tmp_path), ["entry", "content"])).collect()
    assert [(c.id, c.messages[0].content) for c in conv] == [("c1", "hi")]
    totals = C.media_totals(C.media_registry(A.read_zip(spark, str(tmp_path), ["path", "entry", "size"]))).first()
    assert (totals.files, totals.bytes, totals.photos) == (1, 3, 1)


def test_a_run_reads_its_part_of_the_directory_only(spark, tmp_path, monkeypatch):
    entries = [(f"d/ä{i}.txt" if i % 3 else f"d/f{i}.txt", f"{i} ".encode() * 50) for i in range(300)]
    archive(tmp_path / "big.zip", [("d/", b""), *entries[:100], ("e/", b""), *entries[100:], ("f/", b"")])
    packed = (tmp_path / "big.zip").read_bytes()
    (tmp_path / "behind.zip").write_bytes(b"#!/bin/sh\n" * 7 + packed)
    parsed = []
    whole = A._files
    monkeypatch.setattr(A, "_files", lambda z: parsed.append(len(z.infolist())) or whole(z))
    for name in ("big.zip", "behind.zip"):
        parsed.clear()
        reader = A.ZipReader(str(tmp_path / name), A.StructType.fromDDL(A.SCHEMA), 100, 1 << 20, (".zip",))
        parts = reader.partitions()
        got = [(r["entry"], bytes(r["content"]), r["error"]) for p in parts for b in reader.read(p) for r in b.to_pylist()]
        assert got == [(n, d, None) for n, d in entries] and len(parts) > 20
        # Every record is parsed once, not once for each run.
        assert sum(parsed) <= 303
