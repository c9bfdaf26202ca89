import io
import json
import zipfile

from pyspark.sql import functions as F

from stratalore.functions import privacy
from stratalore.sources import connectors as C
from stratalore.sources import files as FS
from stratalore.streaming import ingest as ST
from stratalore.streaming import keyed_state as KS


def node(role, parts, at, text=None):
    return {"message": {"author": {"role": role}, "content": {"parts": parts, "text": text}, "create_time": at}}


CONV = [
    {"id": "c1", "title": "My: chat", "create_time": 1.0, "update_time": 2.0, "mapping": {"a": node("assistant", ["Hi"], 2.0), "b": node("user", ["Hello", "", "World"], 1.0), "s": node("system", ["x"], 0.0), "e": node("user", [], 3.0), "t": node("tool", None, None, "fallback"), "n": {"message": None}}},
    {"id": "c2", "title": "only system", "mapping": {"s": node("system", ["x"], 0.0)}},
]


def archive(path, entries):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, data in entries.items():
            z.writestr(name, data)
    path.write_bytes(buffer.getvalue())


def test_chatgpt_and_facebook_exports(spark, tmp_path):
    archive(tmp_path / "gpt.zip", {"export/conversations.json": json.dumps(CONV), "user.json": "{}"})
    archive(tmp_path / "fb.zip", {
        "posts/your_posts_1.json": json.dumps([{"timestamp": 5, "data": [{"post": "A post"}]}, {"timestamp": 6, "data": []}]),
        "comments/c.json": json.dumps({"comments_v2": [{"timestamp": 7, "data": [{"comment": {"comment": "A comment"}}]}]}),
        "messages/inbox/t/message_1.json": json.dumps({"title": "T", "participants": [{"name": "Ann"}, {"name": "Bob"}], "messages": [{"sender_name": "Ann", "timestamp_ms": 8, "content": "yo"}, {"sender_name": "Bob", "timestamp_ms": 9}]}),
        "posts/media/p.JPG": b"123", "posts/media/v.mp4": b"1",
    })
    (tmp_path / "bad.zip").write_bytes(b"no zip")
    archive(tmp_path / "empty.zip", {})
    entries = FS.zip_entries(FS.read_binary(spark, str(tmp_path), "*.zip"))
    assert entries.where("entry is null").count() == 1
    conv = C.chatgpt_conversations(entries).collect()
    assert [(c.id, c.export_file) for c in conv] == [("c1", "chatgpt_c1_My_ chat.json")]
    assert [(m.role, m.content) for m in conv[0].messages] == [("unknown", "fallback"), ("user", "Hello\nWorld"), ("assistant", "Hi")]
    doc = C.conversation_documents(C.chatgpt_conversations(entries)).first()
    assert doc.text == "unknown: fallback\n\nuser: Hello\nWorld\n\nassistant: Hi" and doc.metadata["source"] == "chatgpt"
    fb = {r.type: r for r in C.facebook_documents(entries).collect()}
    assert fb["post"].text == "A post" and fb["comment"].text == "A comment" and fb["message_thread"].text == "Ann: yo\n\nBob: " and fb["message_thread"].title == "T - Ann, Bob"
    totals = C.media_totals(C.media_registry(entries)).first()
    assert (totals.files, totals.bytes, totals.photos, totals.videos, totals.audios) == (2, 4, 1, 1, 0)


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# hi")
    (tmp_path / "b.json").write_text(json.dumps(CONV))
    (tmp_path / "c.json").write_text('{"x": 1}')
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    (tmp_path / "e.bin").write_bytes(b"\x00\x01\x02abc")
    (tmp_path / "f.bin").write_bytes(b"\xff\xfe\xfa")
    (tmp_path / "g.log").write_text("plain\n")
    got = {r.path.rsplit("/", 1)[-1]: r.text for r in FS.extract_text(FS.read_binary(spark, str(tmp_path))).collect()}
    assert got["a.md"] == "# hi" and got["c.json"] == '{"x": 1}' and got["d.pdf"] is None and got["e.bin"] is None and got["f.bin"] is None and got["g.log"] == "plain\n"
    assert got["b.json"].startswith("# My: chat\n\n[") and "[user]: Hello" in got["b.json"]
    listing = FS.list_files(spark, str(tmp_path))
    manifest = listing.where("filename <> 'a.md'")
    assert [r.filename for r in FS.new_files(listing, manifest).collect()] == ["a.md"]


def test_small_tables(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "id string, at long, status string")
    assert {r.id: r.status for r in C.latest(log, "id", "at").collect()} == {"a": "y", "b": "z"}
    assert C.upsert(log, spark.createDataFrame([("a", 9, "n")], log.schema)).count() == 2
    cookies = spark.createDataFrame([("x.chat.com",), ("evil.org",)], "domain string")
    assert C.cookies_of(cookies, ["chat.com"]).count() == 1
    hours = spark.createDataFrame([(0.1,), (5.0,), (99.0,)], "h double").select(C.interval_hours(F.col("h")).alias("h")).collect()
    assert [r.h for r in hours] == [0.5, 5.0, 24.0]


def test_connector_state(spark, tmp_path):
    cookies = spark.createDataFrame([("x.chatgpt.com",), ("www.claude.ai",), ("evil.org",)], "domain string")
    assert {r.site: r.n for r in C.cookie_counts(cookies).collect()} == {"chatgpt": 1, "claude": 1}
    auth = spark.createDataFrame([("claude", True)], "site string, ok boolean")
    assert C.sites_with_auth(C.sites(spark), auth).count() == 3
    conv = spark.createDataFrame([("c1", "T", 1.0, 2.0, [(1.0, "user", "hi")], "chatgpt_c1_T.json")], "id string, title string, create_time double, update_time double, messages array<struct<create_time:double,role:string,content:string>>, export_file string")
    C.write_exports(conv, str(tmp_path / "x"))
    back = C.read_exports(spark, str(tmp_path / "x"))
    assert C.conversation_documents(back).first().text == "user: hi" and back.first().file.endswith(".json")
    keys = spark.createDataFrame([("auto", {"openai": "k", "groq": "k"}), ("openai", {"groq": "k"}), ("groq", {"groq": "k"})], "p string, k map<string,string>")
    assert [r.v for r in keys.select(C.provider(F.col("p"), F.col("k")).alias("v")).collect()] == ["groq", None, "groq"]
    assert len(keys.select(C.device_fingerprint(F.col("p"), F.lit("h")).alias("v")).first().v) == 32


def test_privacy(spark):
    texts = {1: "mail a.b@c.org now", 2: "call (555) 123-4567", 3: "ssn 123-45-6789", 4: "host 192.168.1.100", 5: "😀 a@b.co and 123-45-6789 and https://x.y/z?q=1", 6: "none", 7: None, 8: "card 4111 1111 1111 1111"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {}
    for r in privacy.detect_pii(docs).collect():
        got.setdefault(r.doc_id, []).append((r.type, texts[r.doc_id][r.start : r.end]))
        raw = texts[r.doc_id].encode()
        assert raw[r.byte_start : r.byte_end].decode() == r.text
    assert got[1] == [("EMAIL", "a.b@c.org")] and got[2][0][0] == "PHONE" and got[3] == [("SSN", "123-45-6789")] and got[4] == [("IP_ADDRESS", "192.168.1.100")]
    assert sorted(k for k, _ in got[5]) == ["EMAIL", "SSN", "URL"] and got[8] == [("CREDIT_CARD", "4111 1111 1111 1111")] and 6 not in got
    masked = privacy.anonymize(docs)
    back = {r.doc_id: r.t for r in masked.select("doc_id", privacy.deanonymize(F.col("masked"), F.col("tokens")).alias("t")).collect()}
    assert back == texts
    assert "a.b@c.org" not in masked.where("doc_id = 1").first().masked
    assert {r.type: r.n for r in privacy.counts_by_type(docs).collect()}["SSN"] == 2


def test_privacy_of_long_texts(spark):
    """Ten thousand spans in one text, across blocks of it: offsets, masking and restoring in one go."""
    import time

    text = "".join(f"é{'x' * (k % 90)} 😀 user{k}@mail{k}.org;\n" for k in range(10_000)) + "tail é" + "y" * 9000
    docs = spark.createDataFrame([(1, text), (2, "é" * 5000), (3, "a@b.co"), (4, ""), (5, None), (6, "<PII:EMAIL:00000000> stays")], "doc_id long, text string")
    began = time.time()
    raw = text.encode()
    found = privacy.detect_pii(docs).where("doc_id = 1").collect()
    assert len(found) == 10_000 and all(text[r.start : r.end] == r.text and raw[r.byte_start : r.byte_end].decode() == r.text for r in found)
    masked = privacy.anonymize(docs)
    rows = {r.doc_id: r for r in masked.select("*", privacy.deanonymize(F.col("masked"), F.col("tokens")).alias("back")).collect()}
    assert rows[1].back == text and "@" not in rows[1].masked and rows[1].masked.endswith("y" * 9000) and len(rows[1].tokens) == 10_000
    assert rows[2].masked == "é" * 5000 and rows[3].masked.startswith("<PII:EMAIL:") and rows[4].masked == "" and rows[5].masked is None and rows[6].back == "<PII:EMAIL:00000000> stays"
    assert time.time() - began < 100


def test_index_stream_across_batches(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    schema = "doc_id long, text string"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)

    def run():
        stream = ST.landed(spark, src, spark.createDataFrame([], schema).schema)
        q = ST.index_stream(stream, out, cp)
        q.awaitTermination(120)

    put([(1, "one"), (2, "two"), (3, None)])
    run()
    put([(4, "two"), (5, "five")])
    run()
    docs = {r.doc_id for r in spark.read.parquet(f"{out}/documents").collect()}
    assert docs == {1, 2, 5}
    jobs = {r.doc_id: (r.status, r.error) for r in spark.read.parquet(f"{out}/jobs").collect()}
    assert jobs == {1: ("completed", None), 2: ("completed", None), 3: ("failed", "no text"), 4: ("completed", "duplicate content"), 5: ("completed", None)}


def test_captures_and_windows(spark, tmp_path):
    src = str(tmp_path / "cap")
    schema = "conv_id long, id string, title string, ts timestamp"
    rows = [(1, "a", None, "2025-01-01 00:00:00"), (1, "a", "T", "2025-01-01 00:00:01"), (1, "b", None, "2025-01-01 00:00:02"), (2, "a", None, "2025-01-01 02:00:00")]
    df = spark.createDataFrame([(*r[:3], r[3]) for r in rows], "conv_id long, id string, title string, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(src)
    stream = lambda: ST.landed(spark, src, df.schema)
    q = KS.merge_captures(stream(), None).writeStream.outputMode("update").format("memory").queryName("caps").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.conv_id: (r.title, r.new_messages, r.total_messages) for r in spark.table("caps").collect()} == {1: ("T", 2, 2), 2: (None, 1, 1)}
    q = ST.new_messages(stream()).writeStream.format("memory").queryName("msgs").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("msgs").count() == 3
    events = df.select("ts", F.col("id").alias("event_type"), F.lit(1.0).alias("value"), F.col("conv_id").alias("user_id"))
    assert ST.event_windows(events).count() == 3 and ST.event_windows(events, "1 hour", "30 minutes").count() == 6
    assert ST.session_windows(events).count() == 2
    assert schema
