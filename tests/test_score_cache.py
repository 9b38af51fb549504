"""The 60-second score cache: requests in any batches equal a plain loop."""

import random
import time
import uuid
from collections import Counter
from datetime import datetime, timedelta

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from moodline.streaming import cache as C
from moodline.streaming import jobs as J

T0 = datetime(2024, 5, 1, 12, 0, 0)
SCHEMA = "event_id long, ts timestamp, text_hash string, sentiment string, toxicity_level string"


def brute(rows, seconds=60):
    entries, out = {}, []
    for event_id, ts, text, sentiment, level in sorted(rows, key=lambda r: (r[1], r[0])):
        e = entries.get(text)
        if e is None or ts >= e["at"] + timedelta(seconds=seconds):
            e = entries[text] = {"at": ts, "first": event_id, "n": 0}
            out.append((text, sentiment, level, e))
        e["n"] += 1
    return Counter((t, s, lv, e["at"], e["first"], e["n"]) for t, s, lv, e in out)


def requests(n, seed, gap=9):
    rng, rows, at = random.Random(seed), [], T0
    for i in range(n):
        at += timedelta(seconds=rng.choice([0, 0, 1, gap, 59, 60]) / rng.choice([1, 4]), microseconds=rng.choice([0, 1]))
        text = rng.choice(["hot", "hot", "hot", "a", "b", None])
        rows.append((i, at, text, "Neutral", "Low"))
    return rows


class Feed:
    def __init__(self, spark, tmp_path):
        self.spark, self.path = spark, str(tmp_path / uuid.uuid4().hex)

    def arrive(self, rows):
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def run(self, name=None, **kw):
        stream = (self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(self.path)
                  .withWatermark("ts", J.WATERMARK))
        got, base = C.cache_entries(stream, name, **kw)
        rows = got.select(*C.KEYS, F.timestamp_micros("scored_us").alias("at"), "first_event_id", "n_requests").collect()
        return Counter(tuple(r) for r in rows), base


def test_requests_in_one_batch(spark, tmp_path):
    feed, rows = Feed(spark, tmp_path), requests(400, 1)
    feed.arrive(rows)
    got, _ = feed.run()
    assert got == brute(rows) and max(r[-1] for r in got) > 5


def test_requests_out_of_order_in_many_batches_and_a_restart(spark, tmp_path):
    rows = requests(600, 2)
    rng = random.Random(5)
    # disorder of less than the watermark's delay
    late = sorted(rows, key=lambda r: r[1] + timedelta(seconds=rng.uniform(0, 250)))
    feed, name = Feed(spark, tmp_path), f"cache-{uuid.uuid4().hex}"
    for part in range(0, 300, 100):
        feed.arrive(late[part:part + 100])
    first, _ = feed.run(name)
    assert first == brute(late[:300])  # entries open so far are given too
    for part in range(300, 600, 100):
        feed.arrive(late[part:part + 100])
    assert feed.run(name)[0] == brute(rows)


def test_state_is_empty_after_the_last_expiry(spark, tmp_path):
    feed, rows = Feed(spark, tmp_path), requests(100, 3)
    feed.arrive(rows)
    far = rows[-1][1] + timedelta(hours=2)
    feed.arrive([(1000, far, "last", "Neutral", "Low")])
    got, base = feed.run()
    assert got == brute(rows + [(1000, far, "last", "Neutral", "Low")])
    keys = spark.read.format("statestore").load(f"{base}/checkpoint").select("key.text_hash").collect()
    assert [r[0] for r in keys] == ["last"]


def test_other_lives(spark, tmp_path):
    feed, rows = Feed(spark, tmp_path), requests(200, 4)
    feed.arrive(rows)
    for seconds in (1, 600):
        assert feed.run(seconds=seconds)[0] == brute(rows, seconds)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=40), st.lists(st.integers(0, 400), max_size=5))
def test_any_cut_gives_the_same_entries(seconds, cuts):
    waiting = [[s * 1_000_000, i] for i, s in enumerate(seconds)]
    whole, _, _ = C.take(None, waiting, float("inf"), 60)
    closed, open_entry, rest = [], None, waiting
    for cut in [*sorted(cuts), float("inf")]:
        done, open_entry, rest = C.take(open_entry, rest, cut * 1_000_000, 60)
        closed += done
        assert all(us >= cut * 1_000_000 for us, _ in rest)
    assert closed == whole and open_entry is None and not rest
    assert sum(e[2] for e in closed) == len(seconds)


def test_an_empty_input(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.arrive([])
    assert feed.run()[0] == Counter()


def test_no_python_call_for_each_text(spark, tmp_path):
    # 20 000 texts: one or two calls for each of them took minutes
    rows = [(i, T0 + timedelta(milliseconds=i), f"t{i % 20_000}", "Neutral", "Low") for i in range(40_000)]
    feed = Feed(spark, tmp_path)
    feed.arrive(rows)
    start = time.monotonic()
    assert feed.run()[0] == brute(rows)
    assert time.monotonic() - start < 60


def test_entries_that_batches_of_arrow_cut(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [r for r in requests(300, 6) if r[2] != "a"]
        first = {}
        for i, at, text, *_ in rows:
            n = first.get((text, at), (i, 0))[1]
            first[text, at] = (first.get((text, at), (i, 0))[0], n + 1)
        us = lambda at: (at - datetime(1970, 1, 1)) // timedelta(microseconds=1)
        data = [(text, "Neutral", "Low", us(at), i, n, us(at)) for (text, at), (i, n) in first.items()]
        got = C.entries(spark.createDataFrame(data, C.LOG)).select(*C.LOG_COLS[:-1]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = brute(rows)
    assert Counter(tuple(r) for r in got) == Counter({(t, s, lv, us(at), i, n): c for (t, s, lv, at, i, n), c in want.items()})
