import hashlib

from pyspark.sql import functions as F

from stratalore.streaming import ingest as ST
from stratalore.streaming import ledger as L


def hashes(spark, texts):
    return spark.createDataFrame([(hashlib.sha256(t.encode()).hexdigest(),) for t in texts], "content_hash string")


def test_a_batch_opens_its_own_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "COMPACT", 3)
    led, texts = L.HashLedger(spark, str(tmp_path)), [f"t{k}" for k in range(700)]
    for n in range(7):
        led.add(n, hashes(spark, texts[n * 100 : n * 100 + 100]))
    assert [f.rsplit("/", 1)[1] for f in led.folders(7)] == ["upto=6", "batch=6"]
    asked = hashes(spark, ["t5", "t650", "new"])
    known = led.known(7, asked)
    want = {hashlib.sha256(t.encode()).hexdigest() for t in texts}
    buckets = {h[: L.DIGITS] for h in (r.content_hash for r in asked.collect())}
    assert {r.content_hash for r in known.collect()} == {h for h in want if h[: L.DIGITS] in buckets}
    files = {r.f for r in known.select(F.input_file_name().alias("f")).distinct().collect()}
    assert {f.split("bucket=h")[1][: L.DIGITS] for f in files} <= buckets and len(files) <= 2 * len(buckets)
    # A repeated batch sees what was there before it, and leaves one copy of its own.
    led.add(6, hashes(spark, texts[600:700]))
    assert led.known(6, asked).count() == sum(h[: L.DIGITS] in buckets for h in (hashlib.sha256(t.encode()).hexdigest() for t in texts[:600]))
    assert led._read(led.folders(7)).count() == 700 and led.known(0, asked).count() == 0


def test_replayed_batches_give_equal_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "COMPACT", 2)
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    schema = "doc_id long, text string"
    saved = []

    def run(rows, checkpoint):
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = ST.landed(spark, src, spark.createDataFrame([], schema).schema, files_per_batch=1)
        assert ST.index_stream(stream, out, checkpoint).awaitTermination(100)
        return sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{out}/documents").collect()), sorted(map(str, spark.read.parquet(f"{out}/jobs").collect()))

    for k in range(5):
        saved.append(run([(10 * k + i, f"text {10 * k + i - (i % 3) * 10}") for i in range(6)] + [(10 * k + 9, None)], cp))
    texts = [t for _, t in saved[-1][0]]
    assert len(texts) == len(set(texts)) and set(texts) == {f"text {10 * k + i - (i % 3) * 10}" for k in range(5) for i in range(6)}
    # All batches once more, as after a lost checkpoint: the same rows, none twice.
    again = run([], str(tmp_path / "cp2"))
    assert sorted(t for _, t in again[0]) == sorted(texts) and len(again[1]) == len(saved[-1][1])
