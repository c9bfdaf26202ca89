"""Chat and social exports, captured conversations and connector state as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalore.functions.text import safe_title
from stratalore.sources.files import CHATGPT, is_media, media_type

POSTS = "array<struct<timestamp:bigint,data:array<struct<post:string>>>>"
COMMENTS = "struct<comments_v2:array<struct<timestamp:bigint,data:array<struct<comment:struct<comment:string>>>>>>"
THREAD = "struct<title:string,participants:array<struct<name:string>>,messages:array<struct<sender_name:string,timestamp_ms:bigint,content:string>>>"
THREAD_MESSAGES, REINDEX_LIMIT = 500, 10_000


def content_text(content: Column) -> Column:
    """Non-empty parts joined by line ends, else the text."""
    parts = F.filter(F.coalesce(content["parts"], F.array().cast("array<string>")), lambda p: p.isNotNull() & (p != ""))
    return F.when(F.size(parts) > 0, F.array_join(parts, "\n")).otherwise(F.coalesce(content["text"], F.lit("")))


def chatgpt_conversations(entries: DataFrame) -> DataFrame:
    """(id, title, create_time, update_time, messages, export_file) of conversations.json entries.

    Messages without text and from the system are left out; the rest is in order of
    time, a missing time first. Conversations without messages are left out.
    """
    named = F.col("entry").endswith("conversations.json") & F.col("entry").rlike("(^|/)conversations\\.json$")  # the first test reaches a source of archives
    raw = entries.where(named).select(F.explode(F.from_json(F.col("content").cast("string"), CHATGPT)).alias("c"))

    def message(n: Column) -> Column:
        role = n["message"]["author"]["role"]
        return F.struct(F.coalesce(n["message"]["create_time"], F.lit(0.0)).alias("create_time"), F.when(role.isin("user", "assistant", "system"), role).otherwise("unknown").alias("role"), content_text(n["message"]["content"]).alias("content"))

    nodes = F.filter(F.map_values("c.mapping"), lambda n: n["message"].isNotNull())
    kept = F.filter(F.transform(nodes, message), lambda m: (m["content"] != "") & (m["role"] != "system"))
    out = raw.select(F.coalesce("c.id", F.lit("unknown")).alias("id"), F.coalesce("c.title", F.lit("Untitled")).alias("title"), "c.create_time", "c.update_time", F.sort_array(kept).alias("messages"))
    named = F.concat(F.lit("chatgpt_"), F.col("id"), F.lit("_"), F.trim(safe_title(F.col("title"))), F.lit(".json"))
    return out.where(F.size("messages") > 0).withColumn("export_file", named)


def conversation_documents(conversations: DataFrame, source: str = "chatgpt") -> DataFrame:
    """(text, metadata) of conversations with messages (role, content)."""
    lines = F.transform(F.filter("messages", lambda m: m["role"].isNotNull() & m["content"].isNotNull()), lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    meta = F.create_map(F.lit("source"), F.lit(source), F.lit("conversationId"), F.col("id"), F.lit("title"), F.col("title"), F.lit("exportFile"), F.col("export_file"))
    return conversations.select(F.array_join(lines, "\n\n").alias("text"), meta.alias("metadata")).where("text <> ''")


def facebook_documents(entries: DataFrame) -> DataFrame:
    """(type, timestamp, title, text) of posts, comments and message threads in an export, by entry path."""
    name, raw = F.lower("entry"), F.col("content").cast("string")
    none = F.lit(None).cast("string")

    def item(kind: str, at: Column, title: Column, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.coalesce(at, F.lit(0).cast("long")).alias("timestamp"), title.alias("title"), text.alias("text"))

    def talk(t: Column) -> Column:
        lines = F.transform(F.slice(t["messages"], 1, THREAD_MESSAGES), lambda m: F.concat(F.coalesce(m["sender_name"], F.lit("")), F.lit(": "), F.coalesce(m["content"], F.lit(""))))
        people = F.array_join(F.transform(F.coalesce(t["participants"], F.array().cast("array<struct<name:string>>")), lambda p: p["name"]), ", ")
        title = F.concat_ws(" - ", F.coalesce(t["title"], F.lit("Unknown thread")), F.nullif(people, F.lit("")))
        return item("message_thread", F.get(t["messages"], F.lit(0))["timestamp_ms"], title, F.array_join(lines, "\n\n"))

    found = {
        "posts": F.transform(F.from_json(raw, POSTS), lambda p: item("post", p["timestamp"], none, F.get(p["data"], F.lit(0))["post"])),
        "comments": F.transform(F.from_json(raw, COMMENTS)["comments_v2"], lambda p: item("comment", p["timestamp"], none, F.get(p["data"], F.lit(0))["comment"]["comment"])),
        "messages": F.transform(F.filter(F.array(F.from_json(raw, THREAD)), lambda t: F.size(t["messages"]) > 0), talk),
    }
    empty = F.array().cast("array<struct<type:string,timestamp:bigint,title:string,text:string>>")
    # An entry is read once, whichever of the three its path says.
    parts = [F.coalesce(F.when(name.contains(k), items), empty) for k, items in found.items()]
    return entries.where(name.endswith(".json")).select(F.inline(F.concat(*parts))).where("text is not null and text <> ''")


def media_registry(entries: DataFrame) -> DataFrame:
    return entries.where(is_media(F.col("entry"))).select("path", "entry", "size", media_type(F.col("entry")).alias("media_type"))


def media_totals(registry: DataFrame) -> DataFrame:
    of = lambda k: F.count_if(F.col("media_type") == k).alias(f"{k}s")
    return registry.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), of("photo"), of("video"), of("audio"))


def captured_documents(messages: DataFrame, conv: str = "conv_id", order: str = "turn", limit: int | None = None) -> DataFrame:
    """(conv_id, text) of flat (conversation, turn, role, text) rows; conversations without text are left out."""
    line = F.concat("role", F.lit(": "), "text")
    rows = messages.where("role is not null and text is not null").groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(F.col(order), line.alias("line")))).alias("m"))
    out = rows.select(conv, F.array_join(F.transform("m", lambda x: x["line"]), "\n\n").alias("text")).where("text <> ''")
    return out.orderBy(conv).limit(limit) if limit else out


def conversations_of(conversations: DataFrame, site: str | None = None, number: int = 1, size: int = 20) -> tuple[DataFrame, DataFrame]:
    """A page of captured conversations (id, site, updated_at), the last updated first, and one row with their total; of all sites or one."""
    mine = conversations if site is None else conversations.where(F.col("site") == site)
    return mine.orderBy(F.desc("updated_at"), "id").offset(max(0, number - 1) * size).limit(size), mine.agg(F.count("*").alias("total"))


def delete_conversations(conversations: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    """All but those in ``gone``; keys that aren't there are no error, conversations without a key stay."""
    return conversations.join(gone.select(key), key, "left_anti").select(*conversations.columns)


def upsert(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``changes`` replace those with the same key."""
    return table.join(changes.select(key), key, "left_anti").unionByName(changes)


def latest(log: DataFrame, key: str, at: str) -> DataFrame:
    """The last row of each key in an appended log; of equal times the one with the largest content."""
    rest = [c for c in log.columns if c != key]
    last = log.groupBy(key).agg(F.max(F.struct(F.col(at), *[F.col(c) for c in rest if c != at])).alias("r"))
    return last.select(key, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*log.columns)


def sites_with_auth(sites: DataFrame, auth: DataFrame) -> DataFrame:
    return sites.join(auth, "site", "left")


def cookies_of(cookies: DataFrame, domains: list[str]) -> DataFrame:
    """Cookies whose domain ends in one of the given ones."""
    ends = F.lit(False)
    for d in domains:
        ends = ends | F.col("domain").endswith(d)
    return cookies.where(ends)


def interval_hours(hours: Column) -> Column:
    return F.greatest(F.lit(0.5), F.least(F.lit(24.0), hours.cast("double")))


# Sites whose conversations can be captured (name, address, cookie domains).
SITES = [
    ("chatgpt", "https://chatgpt.com", [".chatgpt.com", ".openai.com"]),
    ("claude", "https://claude.ai", [".claude.ai", ".anthropic.com"]),
    ("gemini", "https://gemini.google.com", [".google.com", ".gemini.google.com"]),
]


def sites(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SITES, "site string, url string, cookie_domains array<string>")


def cookie_counts(cookies: DataFrame) -> DataFrame:
    """Cookies by site: those whose domain ends in one of the site's."""
    spark = cookies.sparkSession
    ends = sites(spark).select("site", F.explode("cookie_domains").alias("end"))
    # A table of constants: a handful of rows.
    return cookies.join(F.broadcast(ends), F.endswith(F.col("domain"), F.col("end"))).groupBy("site").agg(F.count("*").alias("n"))


def capture_stats(messages: DataFrame, conv: str = "conv_id") -> DataFrame:
    return messages.agg(F.count("*").alias("total_captures"), F.countDistinct(conv).alias("conversations_tracked"))


def write_exports(conversations: DataFrame, path: str) -> None:
    """One JSON line for each conversation."""
    conversations.write.mode("append").json(path)


def read_exports(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """Conversations written by ``write_exports``, and the file each came from."""
    schema = "id string, title string, create_time double, update_time double, messages array<struct<create_time:double,role:string,content:string>>, export_file string"
    return spark.read.schema(schema).option("pathGlobFilter", pattern).json(path).withColumn("file", F.input_file_name())


def rewrite_paths(manifest: DataFrame, old: str, new: str, col: str = "path") -> DataFrame:
    """A manifest after its folder moved: only a leading ``old`` changes."""
    return manifest.withColumn(col, F.when(F.startswith(F.col(col), F.lit(old)), F.concat(F.lit(new), F.substring(F.col(col), F.lit(len(old) + 1), F.char_length(F.col(col))))).otherwise(F.col(col)))


def device_fingerprint(name: Column, host: Column) -> Column:
    """The first 16 bytes of a SHA-256, in hex."""
    return F.left(F.sha2(F.concat(name, host), 256), F.lit(32))


def provider(preferred: Column, keys: Column, order: tuple[str, ...] = ("anthropic", "groq", "openai")) -> Column:
    """The preferred provider if it has a key (map of names to keys), with "auto" the first in order that has one."""
    automatic = F.coalesce(*[F.when(F.element_at(keys, p).isNotNull(), F.lit(p)) for p in order])
    return F.when(preferred == "auto", automatic).otherwise(F.when(F.element_at(keys, preferred).isNotNull(), preferred))
