import random

import pytest
from pyspark.sql import functions as F

from stratalore.streaming import ingest as ST
from stratalore.streaming import keyed_state as KS


@pytest.fixture
def feed(spark, tmp_path):
    """Lands rows and runs a stream over what is new; gives the rows that came out and the last batch's progress."""

    def make(schema, operator, mode, **trigger):
        src, cp, runs = str(tmp_path / "src"), str(tmp_path / "cp"), []

        def put(rows):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
            out = str(tmp_path / f"out{len(runs)}")
            stream = ST.landed(spark, src, spark.createDataFrame([], schema).schema)
            result = operator(stream)
            runs.append(out)
            q = result.writeStream.outputMode(mode).foreachBatch(lambda b, k: b.write.mode("append").parquet(out)).option("checkpointLocation", cp).trigger(**(trigger or {"availableNow": True})).start()
            assert q.awaitTermination(60)
            done = [p for p in q.recentProgress if p["numInputRows"]]
            return [tuple(r) for r in spark.read.schema(result.schema).parquet(out).collect()], done[-1] if done else None

        return put

    return make


CAPTURES = "conv_id long, id string, title string, note string"


def test_captures_write_new_messages_only(feed):
    put = feed(CAPTURES, lambda s: KS.merge_captures(s, None), "update")
    first = [(1, f"m{k}", "A", "") for k in range(200)] + [(2, "x", None, ""), (2, "x", "B", ""), (2, None, None, "")]
    got, before = put(first)
    assert sorted(got) == [(1, "A", 200, 200), (2, "B", 1, 1)]
    got, after = put([(1, f"m{k}", None, "") for k in range(200)] + [(1, "new", "C", ""), (3, None, None, "")])
    assert sorted(got) == [(1, "C", 1, 201), (3, None, 0, 0)]
    written = [p["stateOperators"][0]["customMetrics"]["rocksdbPutCount"] for p in (before, after)]
    assert written[0] >= 200 and written[1] < 40


def test_messages_are_forgotten_after_their_time(feed):
    # State that may end at any time keeps an available-now stream running, so each run is one batch.
    put = feed(CAPTURES, lambda s: KS.merge_captures(s, 1), "update", once=True)
    assert put([(1, "a", "T", "")])[0] == [(1, "T", 1, 1)]
    assert put([(1, "a", None, ""), (1, "b", None, "")])[0] == [(1, None, 2, 2)]


def test_sessions_are_joined_in_any_order():
    rng = random.Random(3)
    for _ in range(200):
        times = [rng.randrange(300) for _ in range(rng.randrange(1, 30))]
        want = KS.joined({}, times, 10)
        spans = {}
        for t in times:
            spans = KS.joined(spans, [t], 10)
        assert spans == want and sum(n for _, n in want.values()) == len(times)
        ends = sorted((s, e) for s, (e, _) in want.items())
        assert all(b[0] - a[1] > 10 for a, b in zip(ends, ends[1:]))


EVENTS = "user_id long, ts timestamp, event_type string"


def test_sessions_close_by_timers(spark, feed):
    def at(*rows):
        return [(u, None if t is None else __import__("datetime").datetime.fromtimestamp(1_700_000_000 + t), "x") for u, t in rows]

    put = feed(EVENTS, lambda s: KS.user_sessions(s, 60, "30 seconds").select("user_id", (F.unix_seconds("start") - 1_700_000_000).alias("a"), (F.unix_seconds("end") - 1_700_000_000).alias("z"), "n"), "append")
    # The watermark is 30 s behind 200: a session that ended by 109 is over.
    assert sorted(put(at((1, 0), (1, 50), (1, 200), (2, 100), (2, None), (None, 5)))[0], key=str) == [(1, 0, 50, 2), (2, 100, 100, 1), (None, 5, 5, 1)]
    # An earlier event that is not late lengthens the open session; later ones close it.
    assert put(at((1, 190), (1, 260)))[0] == []
    assert sorted(put(at((3, 400), (1, 1000)))[0]) == [(1, 190, 260, 3), (3, 400, 400, 1)]
    assert put(at((4, 5000)))[0] == [(1, 1000, 1000, 1)]


def test_many_sessions_of_a_user_need_no_call_for_each(feed):
    """Sessions are as ``joined`` makes them, those exactly the gap apart included, and no state is kept by a Python process."""
    import datetime

    rng, start = random.Random(5), 1_700_000_000
    times = {u: [rng.randrange(0, 60 * 400) for _ in range(200)] + [10_000_000] for u in range(3)}
    times[0] += [-1000, -940, -879]
    rows = [(u, datetime.datetime.fromtimestamp(start + t), "x") for u, ts in times.items() for t in ts]
    put = feed(EVENTS, lambda s: KS.user_sessions(s, 60, "30 seconds").select("user_id", (F.unix_seconds("start") - start).alias("a"), (F.unix_seconds("end") - start).alias("z"), "n"), "append")
    got, progress = put(rows)
    want = [(u, s, e, n) for u, ts in times.items() for s, (e, n) in KS.joined({}, ts, 60).items() if e < 10_000_000]
    assert sorted(got) == sorted(want) and (0, -1000, -940, 2) in got
    assert "Pandas" not in progress["stateOperators"][0]["operatorName"]
