import base64
import gzip
import hashlib

from pyspark.sql import functions as F

from stratalore.llm import warc


def test_round_trip_filters_and_splits(spark, tmp_path):
    pages = [(1, "http://a/\r\nX: y", "<p>é</p>" * 4000), (2, None, "<p>é</p>" * 4000), (3, "http://c", None), (4, "http://d", ""), (5, "http://e", "x\r\n\r\nWARC/1.1\r\n"), (None, "n", "null id")]
    pages += [(k, f"http://many/{k}", f"page {k} " + hashlib.sha256(str(k).encode()).hexdigest() * (k % 50)) for k in range(10, 400)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, payload string").repartition(3)
    path = str(tmp_path / "w")
    warc.write_warc(df, path)
    for split in (1 << 26, 700):
        rows = warc.read_warc(spark, path, split=split).collect()
        assert len(rows) == len(pages)
        by = {r.record_id: r for r in rows}
        assert by["<urn:x-page:1>"].record_type == "response" and by["<urn:x-page:2>"].record_type == "revisit"
        assert by["<urn:x-page:2>"].refers_to == "<urn:x-page:1>" and by["<urn:x-page:4>"].refers_to == "<urn:x-page:3>"
        assert by["<urn:x-page:2>"].payload == b"" and by["<urn:x-page:2>"].payload_bytes == by["<urn:x-page:1>"].payload_bytes == len("<p>é</p>" * 4000) + 4000
        for i, _, html in pages:
            r = by[f"<urn:x-page:{'' if i is None else i}>"]
            assert r.payload_digest == base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()
            assert r.record_type == "revisit" or r.payload == (html or "").encode()
        assert "%0D%0A" in by["<urn:x-page:1>"].target_uri
    few = warc.read_warc(spark, path, ["record_id", "record_type", "target_uri"]).where((F.col("record_type") == "response") & F.col("target_uri").startswith("http://many/1"))
    assert sorted(r.record_id for r in few.collect()) == sorted(f"<urn:x-page:{k}>" for k in range(10, 400) if str(k).startswith("1"))
    reader = warc.WarcReader(path, warc.StructType.fromDDL("record_type string"), 1 << 20)
    assert list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload_bytes",), 3)])) == [warc.EqualTo(("payload_bytes",), 3)]


def test_foreign_archives(spark, tmp_path):
    recs = [b"".join(warc.record(f"<urn:x-page:{k}>", "response", f"u{k}", "D", None, b"p" * k, k)) for k in (0, 5, 90000)]
    (tmp_path / "a.warc").write_bytes(b"".join(recs))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, recs)))
    for name in ("a.warc", "b.warc.gz"):
        for split in (1 << 20, 50):
            got = warc.read_warc(spark, str(tmp_path / name), ["record_id", "payload_bytes", "payload"], split=split).collect()
            assert sorted((r.payload_bytes, r.payload) for r in got) == [(k, b"p" * k) for k in (0, 5, 90000)]
            assert warc.read_warc(spark, str(tmp_path / name), ["record_id"], split=split).count() == 3


def test_archives_as_payloads(spark, tmp_path):
    """Payloads that are archives, plain and packed, of this writer and of another, never start a record."""
    noise = hashlib.sha512(b"0").digest() * 8
    noise = b"".join(hashlib.sha512(noise + bytes([k])).digest() for k in range(40))
    one = b"".join(warc.record("<urn:x-page:inner>", "response", "u", "D", None, noise, len(noise)))
    inner = [one * 3, warc.member(one, noise) * 3, gzip.compress(one + noise) * 3, noise + warc._MARK * 9 + noise]
    recs = [warc.record(f"<urn:x-page:{k}>", "response", "u", "D", None, p, len(p)) for k, p in enumerate(inner * 3)]
    ours = [warc.member(*r, 1) for r in recs]
    assert all(m.count(warc._MARK) == 1 and gzip.decompress(m) == b"".join(r) for m, r in zip(ours, recs, strict=True))
    plain, other = [b"".join(r) for r in recs], [gzip.compress(b"".join(r)) for r in recs]
    for name, parts in {"ours.warc.gz": ours, "plain.warc": plain, "other.warc.gz": other, "joined.warc.gz": [*ours[:5], *other[5:7], *ours[7:]]}.items():
        (tmp_path / name).write_bytes(b"".join(parts))
        for split in (1 << 26, 9001):
            got = warc.read_warc(spark, str(tmp_path / name), ["record_id", "payload"], split=split).collect()
            assert sorted((r.record_id, r.payload) for r in got) == sorted((f"<urn:x-page:{k}>", p) for k, p in enumerate(inner * 3)), (name, split)


def test_query_on_tables_and_empty(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in warc.archive_pages(pages).collect()}
    for r in pages.collect():
        assert got[r.page_id].payload_digest == base64.b32encode(hashlib.sha1(r.html.encode()).digest()).decode()
        assert got[r.page_id].payload_bytes == len(r.html.encode())
    assert warc.archive_pages(pages.limit(0)).count() == 0
