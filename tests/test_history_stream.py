"""The last-n history as a job that is stopped, moved and started again."""

import random
import time
import uuid
from collections import Counter

import pytest

from moodline.session import hadoop_path
from moodline.streaming import jobs as J


def entries(n, seed, sessions=9):
    rng = random.Random(seed)
    rows = [(rng.choice([0, 0, 0, *range(sessions)]), t, rng.choice(["user", None]), f"text {t} é", "Neutral", "Low", "50.0%")
            for t in range(n)]
    rng.shuffle(rows)
    return rows


def brute(rows, n=5):
    out = Counter()
    for s in {r[0] for r in rows}:
        out.update(sorted((r for r in rows if r[0] == s), key=lambda r: -r[1])[:n])
    return out


class Feed:
    def __init__(self, spark, tmp_path, name=None):
        self.spark, self.path, self.name = spark, str(tmp_path / uuid.uuid4().hex), name

    def arrive(self, rows):
        self.spark.createDataFrame(rows, J.HISTORY_SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def run(self, n=5):
        stream = self.spark.readStream.schema(J.HISTORY_SCHEMA).option("maxFilesPerTrigger", 1).parquet(self.path)
        return Counter(map(tuple, J.last_n_stream(stream, n, self.name).collect()))

    @property
    def base(self):
        return J.shared_path(self.spark, f"streams/{self.name}")


def test_started_again_on_other_cores_equals_one_run(spark, tmp_path, monkeypatch):
    rows = entries(120, 1)
    feed = Feed(spark, tmp_path, f"history-{uuid.uuid4().hex}")
    for i, cores in enumerate((3, 16, 5)):
        monkeypatch.setattr(J, "salts", lambda spark, c=cores: c)
        for at in range(40 * i, 40 * i + 40, 20):
            feed.arrive(rows[at:at + 20])
        assert feed.run() == brute(rows[:40 * i + 40])
        assert J.job_salts(spark, feed.base) == 3
    assert feed.run() == brute(rows)  # nothing new arrived


def test_readers_and_log_do_not_grow_with_the_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(J, "MERGE_PARTS", 3)
    rows = entries(110, 2)
    feed = Feed(spark, tmp_path, f"history-{uuid.uuid4().hex}")
    sizes = []
    for at in range(0, 110, 10):  # 11 batches
        feed.arrive(rows[at:at + 10])
    assert feed.run() == brute(rows)
    live, replaced = J.log_parts(spark, f"{feed.base}/log")
    assert [(p.first, p.last, p.level) for p in live][0] == (0, 8, 2)
    assert len(live) <= 3 and [p.last + 1 for p in live][:-1] == [p.first for p in live][1:]
    assert live[-1].last == 10 and len(replaced) <= 12
    J.compact(spark, f"{feed.base}/log", 10)
    assert J.log_parts(spark, f"{feed.base}/log")[1] == []
    assert Counter(map(tuple, J.latest_per_session(spark, f"{feed.base}/log").collect())) == brute(rows)


def test_a_merge_that_failed_is_no_part(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(J, "MERGE_PARTS", 2)
    rows = entries(60, 3)
    feed = Feed(spark, tmp_path, f"history-{uuid.uuid4().hex}")
    for at in range(0, 60, 20):
        feed.arrive(rows[at:at + 20])
    feed.run()
    log = f"{feed.base}/log"
    live, _ = J.log_parts(spark, log)
    merged = next(p for p in live if p.level)
    fs, mark = hadoop_path(spark, f"{log}/{merged.folder}/_SUCCESS")
    fs.delete(mark, False)
    assert all(p.level == 0 for p in J.log_parts(spark, log)[0])
    assert Counter(map(tuple, J.latest_per_session(spark, log).collect())) == brute(rows)


def test_another_n_and_equal_turns(spark, tmp_path):
    rows = entries(50, 4)
    feed = Feed(spark, tmp_path)
    feed.arrive(rows)
    assert feed.run(n=2) == brute(rows, 2) and feed.run(n=1000) == Counter(rows)


@pytest.mark.parametrize("folder, want", [("v=7", (7, 7, 0)), ("v=0-63.2", (0, 63, 2))])
def test_names_of_parts(folder, want):
    p = J.LogPart(folder)
    assert (p.first, p.last, p.level) == want and not p.inside(p)


def test_no_python_call_for_each_session(spark, tmp_path):
    # 20 000 sessions in two batches: one call for each of them took minutes
    rows = [(i % 20_000, t, "user", "text", "Neutral", "Low", "50.0%") for t, i in enumerate(range(40_000))]
    feed = Feed(spark, tmp_path)
    feed.arrive(rows[:20_000])
    feed.arrive(rows[20_000:])
    start = time.monotonic()
    assert feed.run(n=1) == brute_last(rows)
    assert time.monotonic() - start < 60


def brute_last(rows):
    newest = {}
    for r in rows:
        newest[r[0]] = r
    return Counter(newest.values())
