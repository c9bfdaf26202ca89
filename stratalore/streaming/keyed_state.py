"""Streams with state for each key that ends by itself: messages with a time to live, sessions closed by the watermark.

State is kept value by value in the store of the stream (RocksDB): a batch writes what
it adds and reads what it asks for, however much a key has gathered. Sessions are Spark's
session windows, joined and closed without a call to Python for each of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stratalore.session import ship

MERGED = "conv_id long, title string, new_messages long, total_messages long"


def use_state_store(spark: SparkSession) -> None:
    """State of single values needs the RocksDB store; streams that have begun keep the store they have."""
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Captures(StatefulProcessor):
    """Ids of a conversation's messages, one value each; its last title and the number of messages."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.messages = handle.getMapState("messages", "id string", "known boolean", self.ttl_ms)
        self.conversation = handle.getValueState("conversation", "title string, total long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        title, total = self.conversation.get() or (None, 0)
        new, here = 0, set()
        for part in rows:
            for message, name in zip(part["id"], part["title"], strict=True):
                title = name if isinstance(name, str) else title
                if message is None or message in here:
                    continue
                here.add(message)
                if not self.messages.containsKey((message,)):
                    self.messages.updateValue((message,), (True,))
                    new += 1
        self.conversation.update((title, total + new))
        yield pd.DataFrame({"conv_id": [key[0]], "title": [title], "new_messages": [new], "total_messages": [total + new]})

    def close(self) -> None:
        pass


def merge_captures(stream: DataFrame, ttl_ms: int | None = 3_600_000) -> DataFrame:
    """Captured conversations (conv_id, id, title): new messages of each batch, all so far, the last title given.

    A message is known for ``ttl_ms`` after it first came, a conversation's count for
    ``ttl_ms`` after its last batch; None keeps all. A batch writes one value for each
    new message and one for each conversation it has rows of. Messages without an id
    are left out, those that come again count once. Use it in update mode; with a time
    to live an available-now stream has no end, since values may still expire.
    """
    use_state_store(stream.sparkSession)
    rows = stream.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("id").cast("string").alias("id"), F.col("title").cast("string").alias("title"))
    return rows.groupBy("conv_id").transformWithStateInPandas(Captures(ttl_ms), MERGED, "Update", "None" if ttl_ms is None else "ProcessingTime")


def joined(spans: dict[int, tuple[int, int]], times: list[int], gap: int) -> dict[int, tuple[int, int]]:
    """Sessions (start to end and number) after more events; those at most ``gap`` apart are one."""
    parts = sorted([(s, e, n) for s, (e, n) in spans.items()] + [(t, t, 1) for t in times])
    out: list[list[int]] = []
    for start, end, n in parts:
        if out and start - out[-1][1] <= gap:
            out[-1][1], out[-1][2] = max(out[-1][1], end), out[-1][2] + n
        else:
            out.append([start, end, n])
    return {s: (e, n) for s, e, n in out}


def user_sessions(events: DataFrame, gap_seconds: int = 3600, late: str = "10 minutes", user: str = "user_id", at: str = "ts") -> DataFrame:
    """(user_id, start, end, n) of sessions, each once, when the watermark says that it is over.

    Events of a user at most ``gap_seconds`` apart are one session (as ``joined`` makes
    them), in whatever order they come within ``late``. Events without a time are left out.
    """
    use_state_store(events.sparkSession)
    timed = events.select(F.col(user).cast("long").alias("user_id"), F.col(at).cast("timestamp").alias("ts")).withWatermark("ts", late)
    # A window ends before its last instant: one microsecond more joins events that are the whole gap apart.
    rows = timed.groupBy("user_id", F.session_window("ts", f"{gap_seconds} seconds 1 microsecond").alias("w")).agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"))
    return rows.select("user_id", "start", "end", "n")
