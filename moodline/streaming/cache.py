"""A score cache whose entries live a fixed time from the request that
filled them.

The first request for a text scores it; requests for the same text less than
``SECONDS`` later are answered from the cache; the next one after that scores
again. Requests count in event time, so the result does not depend on how they
are cut into micro-batches: requests of a text at one time wait in the state (a
native aggregate, one row for each text and time of the last ``WATERMARK``)
until the watermark has passed them and nothing earlier can come any more. A
micro-batch takes those it gets in order, after the entries that were open so
far, by one sorted pass over all texts of a task. Its entries are written to a
folder of its batch id; those that a later request may still use are taken up
by the next batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodline.streaming import jobs as J

#: Fixed value: life of an entry.
SECONDS = 60
KEYS = ["text_hash", "sentiment", "toxicity_level"]
#: Times in microseconds.
ENTRY = "text_hash string, sentiment string, toxicity_level string, scored_us long, first_event_id long, n_requests long"
#: An entry and a time that its requests (or it) have reached. Requests have
#: this form too: an entry of their own time.
LOG = ENTRY + ", last_us long"
LOG_COLS = [c.split()[0] for c in LOG.split(", ")]


def take(open_entry: list | None, waiting: list, before: float, seconds: int) -> tuple[list, list | None, list]:
    """(closed entries, open entry, requests that wait): the requests earlier
    than ``before`` are taken in order of (time, id), and an entry that expires
    by then is closed. An entry is [time it was scored, first id, requests]; a
    third item of a request is how many it stands for."""
    life, closed = seconds * 1_000_000, []
    waiting = sorted(waiting)
    taken = 0
    for us, event_id, *n in waiting:
        if us >= before:
            break
        taken += 1
        if open_entry is not None and us < open_entry[0] + life:
            open_entry[2] += n[0] if n else 1
            continue
        if open_entry is not None:
            closed.append(open_entry)
        open_entry = [us, event_id, n[0] if n else 1]
    if open_entry is not None and open_entry[0] + life <= before:
        closed.append(open_entry)
        open_entry = None
    return closed, open_entry, waiting[taken:]


def _entries_of(rows: pa.RecordBatch, seconds: int) -> pa.RecordBatch:
    """LOG entries of sorted LOG requests, in their order. A request that comes
    ``seconds`` or more after the one before it begins an entry in any case;
    only what lies between two such requests and is longer is taken by steps."""
    life = seconds * 1_000_000
    us, n, last = (rows.column(i).to_numpy() for i in (3, 5, 6))
    new = np.ones(len(us), bool)
    new[1:] = np.diff(us) >= life
    for i in range(len(KEYS)):
        code = rows.column(i).dictionary_encode("encode").indices.to_numpy()
        new[1:] |= code[1:] != code[:-1]
    first = np.flatnonzero(new)
    end = np.append(first[1:], len(us))
    long = us[end - 1] - us[first] >= life
    at, total, reached = [first[~long]], [np.add.reduceat(n, first)[~long]], [np.maximum.reduceat(last, first)[~long]]
    for a, b in zip(first[long].tolist(), end[long].tolist(), strict=True):
        steps, _, _ = take(None, [(t, i, m) for i, (t, m) in enumerate(zip(us[a:b].tolist(), n[a:b].tolist(), strict=True))],
                           float("inf"), seconds)
        where = a + np.array([i for _, i, _ in steps])
        at.append(where)
        total.append(np.array([m for _, _, m in steps]))
        reached.append(np.append(us[where[1:]], last[a:b].max()))
    at, total, reached = (np.concatenate(x) for x in (at, total, reached))
    order = np.argsort(at)
    kept = rows.select(LOG_COLS[:5]).take(pa.array(at[order]))
    return pa.RecordBatch.from_arrays([*kept.columns, pa.array(total[order]), pa.array(reached[order])], LOG_COLS)


def entries(requests: DataFrame, seconds: int = SECONDS) -> DataFrame:
    """LOG entries of LOG requests (at most one of a text at one time). The
    tasks read them by text and time; only the last entry is held back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            if not batch.num_rows:
                continue
            # an entry goes on as a request of its time that stands for all of its requests
            done = _entries_of(batch if left is None else pa.concat_batches([left, batch.cast(left.schema)]), seconds)
            left = done.slice(done.num_rows - 1)
            yield done.slice(0, done.num_rows - 1)
        if left is not None:
            yield left

    return requests.select(*LOG_COLS).repartition(*KEYS).sortWithinPartitions(*KEYS, "scored_us").mapInArrow(run, LOG)


def _with_reached(log: DataFrame, seconds: int) -> DataFrame:
    """LOG rows and whether the requests of their batch (one row each in the
    broadcast) have reached their expiry: no later request is earlier."""
    ends = log.groupBy("v").agg(F.max("last_us").alias("_end"))
    closed = F.col("scored_us") + seconds * 1_000_000 <= F.col("_end")
    return log.join(F.broadcast(ends), "v").withColumn("closed", closed).drop("_end")


def cache_entries(requests: DataFrame, name: str | None = None, seconds: int = SECONDS) -> tuple[DataFrame, str]:
    """Entries (ENTRY) of a stream of requests (ts with a watermark, event_id,
    text_hash, sentiment, toxicity_level): those that are closed and those open
    at the end of the input. Requests without a text share one entry with a
    null hash; one without a time is no request. The job's folder."""
    spark = requests.sparkSession
    base = J.job_path(spark, "cached_scores", name)
    at_once = requests.filter(F.col("ts").isNotNull()).groupBy(*KEYS, "ts").agg(F.min("event_id"), F.count(F.lit(1)))
    us = F.unix_micros("ts")
    rows = at_once.select(*KEYS, us.alias("scored_us"), F.col("min(event_id)").alias("first_event_id"),
                          F.col("count(1)").alias("n_requests"), us.alias("last_us"))

    def step(batch: DataFrame, batch_id: int) -> None:
        before = J.read_folder(batch.sparkSession, f"{base}/log", batch_id - 1, LOG)
        still_open = _with_reached(before, seconds).filter("NOT closed").select(*LOG_COLS)
        entries(batch.unionByName(still_open), seconds).write.mode("overwrite").parquet(f"{base}/log/v={batch_id}")

    try:
        (rows.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/checkpoint")
         .trigger(availableNow=True).start().awaitTermination())
    finally:
        J.release_static()
    log = _with_reached(J.read_log(spark, f"{base}/log", J.schema_of(LOG)), seconds)
    # what is open goes from batch to batch: the last one has all of it
    newest = log.agg(F.max("v").alias("v"))
    still_open = log.filter("NOT closed").join(F.broadcast(newest), "v", "left_semi")
    rest = entries(still_open.select(*LOG_COLS).unionByName(waiting_requests(spark, base)), seconds)
    names = LOG_COLS[:-1]
    return log.filter("closed").select(*names).unionByName(rest.select(*names)), base


def waiting_requests(spark: SparkSession, base: str) -> DataFrame:
    """LOG requests in the job's state that the watermark has not passed."""
    if not J.path_exists(spark, f"{base}/checkpoint/state"):
        return spark.createDataFrame([], LOG)
    us = F.unix_micros("key.ts")
    return spark.read.format("statestore").load(f"{base}/checkpoint").select(
        *[F.col(f"key.{k}").alias(k) for k in KEYS], us.alias("scored_us"), F.col("value.min").alias("first_event_id"),
        F.col("value.count").alias("n_requests"), us.alias("last_us"))


def cached_scores_stream(spark: SparkSession, sf_dir: str, name: str | None = None) -> DataFrame:
    """One row for each time a text is scored: the score, when, by which event,
    and how many requests it answers within its 60 seconds."""
    events = J.event_stream(spark, sf_dir).withWatermark("ts", J.WATERMARK)
    scored = J.scored_events(spark, sf_dir, events)
    entries, _ = cache_entries(scored, name)
    at = F.timestamp_micros("scored_us")
    return entries.select(*KEYS, at.cast("timestamp_ntz").alias("scored_at"),
                          (at + F.expr(f"INTERVAL {SECONDS} SECONDS")).cast("timestamp_ntz").alias("expires_at"),
                          "first_event_id", "n_requests")
