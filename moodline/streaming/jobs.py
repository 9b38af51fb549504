"""Structured Streaming jobs (R3-R7, R4b, scoring of unseen text).

Each job reads a table as a file stream, runs with ``availableNow`` into a
sink and returns the sink as a batch DataFrame. A job that is given a name
keeps its checkpoint and sink under ``<checkpoint dir>/moodline/streams/<name>``:
started again, by any application, it goes on where it stopped. Without a
name it gets folders of its own. ``moodline.stream.maxFilesPerTrigger`` bounds
the input of a micro-batch.

Event time: ``events.ts`` is TIMESTAMP_NTZ, which ``withWatermark`` rejects, so
it is read as a session-time-zone TIMESTAMP and written back as NTZ.

Append mode emits a window once the watermark (max event time - delay) has
passed its end. The windows still open at the end of the input are read from
the job's state store, so every event is counted in the result.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from moodline.functions import scoring as S
from moodline.operators import scorer as K
from moodline.operators.joins import broadcast_bound, materialize
from moodline.plans.common import train_model
from moodline.session import hadoop_path, scratch_path, shared_path
from moodline.sources.tables import documents_clean, input_state, read_keyed, read_table, table_path

WATERMARK = "10 minutes"
WINDOW = "1 hour"
SESSION_GAP = "30 minutes"
DEDUPE_WINDOW = "1 minute"
HISTORY_N = 5
FEED_BATCHES = 4
MERGE_CONF = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"
MAX_FILES_CONF = "moodline.stream.maxFilesPerTrigger"
#: Sentiment and band of an event whose post cannot be scored.
ERROR = "Error"


def table_stream(spark: SparkSession, sf_dir: str, name: str, **options) -> DataFrame:
    """A table as a file stream. A glob keeps a single-file table and a
    directory of part files readable alike."""
    schema = read_table(spark, sf_dir, name).schema
    path = table_path(sf_dir, name).replace(f"/{name}.parquet", f"/{name}*.parquet")
    limit = spark.conf.get(MAX_FILES_CONF, "")
    if limit:
        options["maxFilesPerTrigger"] = limit
    return spark.readStream.schema(schema).options(**options).parquet(path)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table_stream(spark, sf_dir, "events")
    return ev.withColumn("ts", F.col("ts").cast("timestamp"))


def job_path(spark: SparkSession, kind: str, name: str | None) -> str:
    return shared_path(spark, f"streams/{name}") if name else scratch_path(spark, f"streams/{kind}")


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_path(spark, path)
    return fs.exists(p)


def run_to_parquet(df: DataFrame, kind: str, name: str | None = None) -> tuple[DataFrame, str]:
    """Run the streaming plan to the end of its input (availableNow) into a
    Parquet sink; the sink as a batch DataFrame, and the job's folder."""
    spark = df.sparkSession
    base = job_path(spark, kind, name)
    try:
        q = (df.writeStream.format("parquet").outputMode("append")
             .option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
             .trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        release_static()
    return spark.read.schema(df.schema).parquet(f"{base}/out"), base


def release_static() -> None:
    """Free the static sides kept for the job that has ended."""
    while _KEPT:
        _KEPT.pop().unpersist()


def with_open_windows(closed: DataFrame, base: str, columns: list[Column]) -> DataFrame:
    """``closed`` (emitted windows) and the windows still in the state of the
    job's only stateful operator; ``columns`` over its key and value."""
    state = closed.sparkSession.read.format("statestore").load(f"{base}/checkpoint")
    return closed.unionByName(state.select(*columns))


def run_batches(df: DataFrame, kind: str, name: str | None, schema: Ty.StructType,
                per_batch: Callable[[DataFrame, int, str], DataFrame]) -> DataFrame:
    """Run ``per_batch`` (rows, batch id, the job's folder) on each micro-batch;
    the rows of batch b go to folder ``v=b``, so a batch that is run again
    writes the same folder again."""
    spark = df.sparkSession
    base = job_path(spark, kind, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        per_batch(batch, batch_id, base).write.mode("overwrite").parquet(f"{base}/log/v={batch_id}")

    q = (df.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return read_log(spark, f"{base}/log", schema)


def read_log(spark: SparkSession, log: str, schema: Ty.StructType) -> DataFrame:
    """Rows of all batches with their batch id ``v``; none if no batch ran."""
    full = Ty.StructType(schema.fields + [Ty.StructField("v", Ty.LongType())])
    if not path_exists(spark, log):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(log)


def schema_of(ddl: str) -> Ty.StructType:
    return Ty.StructType.fromDDL(ddl)


def read_folder(spark: SparkSession, log: str, batch_id: int, ddl: str) -> DataFrame:
    """Rows of one batch with its id ``v``; none if it wrote none."""
    full = schema_of(f"{ddl}, v long")
    folder = f"{log}/v={batch_id}"
    if not path_exists(spark, folder):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("basePath", log).parquet(folder)


_STATIC: dict[tuple, tuple[DataFrame, int, int]] = {}
#: Static sides kept for the job that is running.
_KEPT: list[DataFrame] = []


def scored_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, int]:
    """Static side of the stream-static joins: doc_id, text_hash, rule-A
    sentiment, band of every document (``Error`` where it cannot be scored);
    its row count, the number of documents. Written once per application and
    input (micro-batches and later jobs do not re-run the scorer)."""
    key = (spark.sparkContext.applicationId, input_state(spark, sf_dir, "documents", "labels"))
    if key not in _STATIC:
        model, _ = train_model(spark, sf_dir)
        docs = documents_clean(spark, sf_dir).select(
            "doc_id", "text", F.when(F.col("has_text"), F.sha2("text", 256)).alias("text_hash"))
        pr = K.app_fields(K.probabilities(model, docs, ["doc_id", "text_hash"], "text", outer=True))
        ok = F.col("n_known") > 0
        static = materialize(pr.select("doc_id", "text_hash", *[
            F.when(ok, F.col(c)).otherwise(F.lit(ERROR)).alias(c) for c in ("sentiment", "toxicity_level")]))
        n = static.count()
        _STATIC[key] = (static, n, n)
    return _STATIC[key]


def _join_static(ev: DataFrame, static: DataFrame, n_static: int) -> DataFrame:
    """Stream-static left join on doc_id; no event is lost. The static side is
    broadcast only when its counted rows are within the bound. Beyond it, the
    static side is hash-partitioned by doc_id and kept (memory and disk; lost
    blocks are recomputed from the written table) while the job runs, so each
    micro-batch shuffles only its own events to it."""
    if n_static <= broadcast_bound(ev.sparkSession):
        return ev.join(F.broadcast(static), "doc_id", "left")
    _KEPT.append(static.repartition("doc_id").persist(StorageLevel.MEMORY_AND_DISK))
    return ev.join(_KEPT[-1], "doc_id", "left")


def _with_doc(ev: DataFrame, n_docs: int) -> DataFrame:
    # events carry no post reference: event i shows post i mod n_docs
    return ev.withColumn("doc_id", F.pmod(F.col("event_id"), F.lit(n_docs)))


def scored_events(spark: SparkSession, sf_dir: str, ev: DataFrame) -> DataFrame:
    static, n_static, n_docs = scored_documents(spark, sf_dir)
    joined = _join_static(_with_doc(ev, n_docs), static, n_static)
    return joined.withColumns({c: F.coalesce(c, F.lit(ERROR)) for c in ("sentiment", "toxicity_level")})


def stream_scored(spark: SparkSession, sf_dir: str, name: str | None = None) -> DataFrame:
    """Every event joined (stream-static) to the scored post it shows."""
    out = scored_events(spark, sf_dir, event_stream(spark, sf_dir)).select(
        "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "doc_id",
        "sentiment", "toxicity_level")
    return run_to_parquet(out, "stream_scored", name)[0]


def toxicity_by_hour(spark: SparkSession, sf_dir: str, name: str | None = None) -> DataFrame:
    """Tumbling one-hour counts of events per toxicity band (posts that
    cannot be scored count as band ``Error``)."""
    ev = scored_events(spark, sf_dir, event_stream(spark, sf_dir).withWatermark("ts", WATERMARK))
    agg = ev.groupBy(F.window("ts", WINDOW).alias("w"), "toxicity_level").agg(F.count(F.lit(1)).alias("n_events"))

    def shape(w: str, level: str, n: str) -> list[Column]:
        return [F.col(f"{w}.start").cast("timestamp_ntz").alias("window_start"),
                F.col(f"{w}.end").cast("timestamp_ntz").alias("window_end"),
                F.col(level).alias("toxicity_level"), F.col(n).alias("n_events")]

    closed, base = run_to_parquet(agg.select(*shape("w", "toxicity_level", "n_events")), "toxicity_by_hour", name)
    return with_open_windows(closed, base, shape("key.window", "key.toxicity_level", "value.count"))


def user_sessions(spark: SparkSession, sf_dir: str, name: str | None = None) -> DataFrame:
    """Sessions of activity per user (30 minute inactivity gap)."""
    ev = event_stream(spark, sf_dir).withWatermark("ts", WATERMARK)
    agg = (ev.groupBy(F.session_window("ts", SESSION_GAP).alias("s"), "user_id")
           .agg(F.count(F.lit(1)).alias("n_events")))

    def shape(s: str, user: str, n: str) -> list[Column]:
        return [F.col(user).alias("user_id"), F.col(f"{s}.start").cast("timestamp_ntz").alias("session_start"),
                F.col(f"{s}.end").cast("timestamp_ntz").alias("session_end"), F.col(n).alias("n_events")]

    # sessions of a key are merged inside each task before the shuffle (a
    # partial aggregate for a very active user); the caller's setting returns
    before = spark.conf.get(MERGE_CONF, "false")
    spark.conf.set(MERGE_CONF, "true")
    try:
        closed, base = run_to_parquet(agg.select(*shape("s", "user_id", "n_events")), "user_sessions", name)
    finally:
        spark.conf.set(MERGE_CONF, before)
    return with_open_windows(closed, base, shape("value.session_window", "key.user_id", "value.count"))


def dedupe_per_minute(spark: SparkSession, sf_dir: str, name: str | None = None) -> DataFrame:
    """A text is scored at most once per minute: one row per (minute,
    text) with the score, the first request and the number of requests it
    answers. Requests without a text share a row with a null hash."""
    ev = scored_events(spark, sf_dir, event_stream(spark, sf_dir).withWatermark("ts", WATERMARK))
    # equal texts have equal scores, so the score may be part of the key
    agg = (ev.groupBy(F.window("ts", DEDUPE_WINDOW).alias("w"), "text_hash", "sentiment", "toxicity_level")
           .agg(F.min("event_id").alias("first_event_id"), F.count(F.lit(1)).alias("n_requests")))

    def shape(w: str, key: str, first: str, n: str) -> list[Column]:
        return [F.col(f"{w}.start").cast("timestamp_ntz").alias("minute_start"),
                *[F.col(f"{key}{c}").alias(c) for c in ("text_hash", "sentiment", "toxicity_level")],
                F.col(first).alias("first_event_id"), F.col(n).alias("n_requests")]

    closed, base = run_to_parquet(agg.select(*shape("w", "", "first_event_id", "n_requests")),
                                  "dedupe_per_minute", name)
    return with_open_windows(closed, base, shape("key.window", "key.", "value.min", "value.count"))


# ------------------------------------------------------------ unseen text
TEXT_SCORES = Ty.StructType([
    Ty.StructField("conv_id", Ty.LongType()), Ty.StructField("turn", Ty.LongType()),
    Ty.StructField("sentiment", Ty.StringType()), Ty.StructField("toxicity_level", Ty.StringType()),
    *[Ty.StructField(c, Ty.DoubleType()) for c in K.PROB_COLS]])


def score_texts(model, batch: DataFrame) -> DataFrame:
    """TEXT_SCORES rows of a batch (conv_id, turn, text). Every row is kept: a
    text that cannot be scored gets ``Error`` and null probabilities."""
    pr = K.app_fields(K.probabilities(model, batch.select("conv_id", "turn", "text"), ["conv_id", "turn"],
                                      "text", outer=True))
    ok = F.col("n_known") > 0
    return pr.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                     *[F.when(ok, F.col(c)).otherwise(F.lit(ERROR)).alias(c) for c in ("sentiment", "toxicity_level")],
                     *[F.when(ok, F.col(c)).alias(c) for c in K.PROB_COLS])


def score_text_stream(stream: DataFrame, model, name: str | None = None) -> DataFrame:
    """Score the texts (conv_id, turn, text) that arrive in a stream, inside
    each micro-batch, with one model."""
    return run_batches(stream, "score_text", name, TEXT_SCORES, lambda batch, _, __: score_texts(model, batch)).drop("v")


def stream_score_text(spark: SparkSession, sf_dir: str, name: str | None = None) -> DataFrame:
    """The turns of ``conversations`` as a stream of unseen text, scored with a
    model that was registered and loaded again."""
    from moodline.sources.model_store import MODEL_NAME, ModelStore
    model, _ = train_model(spark, sf_dir)
    root = scratch_path(spark, "models")
    ModelStore(spark, root).register(MODEL_NAME, model)
    loaded = ModelStore(spark, root).load(MODEL_NAME)
    return score_text_stream(table_stream(spark, sf_dir, "conversations"), loaded, name)


VERSIONED_SCORES = Ty.StructType(TEXT_SCORES.fields + [Ty.StructField("model_version", Ty.IntegerType())])
#: Fixed value: a running job looks for a newer model once an hour.
MODEL_CHECK_SECONDS = 3600


class ModelPins:
    """Which version of a model each micro-batch of a job uses. A batch takes
    the newest complete version and records it before it scores (an empty file
    named after both), so a batch that is run again uses the same one. Versions
    are looked up again after ``check_seconds``; a job that starts looks at once."""

    def __init__(self, store, model_name: str, check_seconds: float = MODEL_CHECK_SECONDS) -> None:
        self.store, self.name, self.check_seconds = store, model_name, check_seconds
        self._newest, self._looked = None, None
        self._models: dict[int, object] = {}

    def newest(self) -> int:
        now = time.monotonic()
        if self._looked is None or now - self._looked >= self.check_seconds:
            found = self.store.versions(self.name)
            if not found:
                raise LookupError(f"no complete version of model {self.name!r}")
            self._newest, self._looked = found[-1], now
        return self._newest

    def version(self, batch_id: int, folder: str) -> int:
        fs, p = hadoop_path(self.store.spark, folder)
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        pinned = [int(n.split("version=")[1]) for n in names if n.startswith(f"batch={batch_id}.")]
        if pinned:
            return min(pinned)
        version = self.newest()
        fs, pin = hadoop_path(self.store.spark, f"{folder}/batch={batch_id}.version={version}")
        fs.createNewFile(pin)
        return version

    def load(self, version: int):
        if version not in self._models:
            self._models = {version: self.store.load(self.name, version)}  # the one in use
        return self._models[version]


def score_latest_stream(stream: DataFrame, store, model_name: str, name: str | None = None,
                        check_seconds: float = MODEL_CHECK_SECONDS) -> DataFrame:
    """Score the texts (conv_id, turn, text) that arrive in a stream with the
    newest model of the store; a version registered while the job runs is taken
    up by a later micro-batch. Each row names its version."""
    pins = ModelPins(store, model_name, check_seconds)

    def score(batch: DataFrame, batch_id: int, base: str) -> DataFrame:
        version = pins.version(batch_id, f"{base}/pins")
        return score_texts(pins.load(version), batch).withColumn("model_version", F.lit(version).cast("int"))

    return run_batches(stream, "score_latest", name, VERSIONED_SCORES, score).drop("v")


def stream_model_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R3 with S5: conversations with an even id arrive, a second version of the
    model (other smoothing) is registered, and the others arrive."""
    from moodline.sources.model_store import MODEL_NAME, ModelStore
    store, folder = ModelStore(spark, scratch_path(spark, "models")), scratch_path(spark, "streams/turns")
    name = f"model-change-{uuid.uuid4().hex}"
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    odd, out = F.col("conv_id") % 2 != 0, None
    for part, alpha in ((turns.filter(~odd), 1.0), (turns.filter(odd), 2.0)):
        store.register(MODEL_NAME, train_model(spark, sf_dir, alpha=alpha)[0])
        part.write.mode("append").parquet(folder)
        out = score_latest_stream(spark.readStream.schema(turns.schema).parquet(folder), store, MODEL_NAME, name)
    return out


# ------------------------------------------------------------ R4b: history
HISTORY_COLS = ["conv_id", "turn", "role", "preview", "sentiment", "toxicity_level", "confidence_text"]
HISTORY_SCHEMA = Ty.StructType([
    Ty.StructField("conv_id", Ty.LongType()), Ty.StructField("turn", Ty.LongType()),
    Ty.StructField("role", Ty.StringType()), Ty.StructField("preview", Ty.StringType()),
    Ty.StructField("sentiment", Ty.StringType()), Ty.StructField("toxicity_level", Ty.StringType()),
    Ty.StructField("confidence_text", Ty.StringType())])
SALTED_SCHEMA = Ty.StructType(HISTORY_SCHEMA.fields + [Ty.StructField("_salt", Ty.IntegerType())])
LOG_SCHEMA = Ty.StructType(SALTED_SCHEMA.fields + [Ty.StructField("v", Ty.LongType())])
#: So many neighbouring parts of a log of one level become one of the next.
MERGE_PARTS = 8


def salts(spark: SparkSession) -> int:
    """Lists are kept by (session, salt): a session with a third of all rows
    is spread over as many tasks as the cluster runs at once, each keeping its
    own last n."""
    return max(8, spark.sparkContext.defaultParallelism)


def job_salts(spark: SparkSession, base: str) -> int:
    """The number of salts of a job, fixed in its folder by its first start:
    the log of a job that goes on elsewhere keeps its keys."""
    fs, folder = hadoop_path(spark, f"{base}/settings")
    found = [int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(folder)] if fs.exists(folder) else []
    if found:
        return min(found)
    n = salts(spark)
    fs.createNewFile(hadoop_path(spark, f"{base}/settings/salts={n}")[1])
    return job_salts(spark, base)


def _last_n_state(n: int):
    """The step for one key as a function of applyInPandasWithState, for jobs with
    few keys; ``last_n_stream`` takes all keys of a batch natively."""
    import heapq
    import json

    import pandas as pd

    fields = HISTORY_COLS[1:]
    turn = fields.index("turn")

    def update(key, chunks, state):
        kept = [tuple(e) for e in json.loads(state.get[0])] if state.exists else []
        for chunk in chunks:  # Arrow-sized chunks: memory bounded by chunk + n
            kept = heapq.nlargest(n, [*kept, *chunk[fields].itertuples(index=False, name=None)], key=lambda e: e[turn])
        state.update((json.dumps([[int(x) if i == turn else x for i, x in enumerate(e)] for e in kept]),))
        cols = HISTORY_COLS + ["_salt"] * (len(key) > 1)  # salted key: (session, salt)
        yield pd.DataFrame([(key[0], *e, *key[1:]) for e in kept], columns=cols).astype({"turn": "int64"})
    return update


def last_n_stream(stream: DataFrame, n: int = HISTORY_N, name: str | None = None) -> DataFrame:
    """The last n history entries of each session (HISTORY_SCHEMA
    rows that arrive in a stream), kept as a log of last-n lists.

    Each micro-batch appends the last n of the rows it brought for each
    (session, salt), in a folder of its own batch id, so a replayed batch
    rewrites the same folder; it reads nothing of what is there. Parts of the
    log are merged as they become many (``compact``), so that neither the log
    nor what a reader reads grows with the number of batches. All steps are
    native: no call for each session. A job with a name goes on where it
    stopped, on any number of cores."""
    spark = stream.sparkSession
    base = job_path(spark, "history_last_n", name)
    n_salts = job_salts(spark, base)
    salted = stream.withColumn("_salt", F.pmod(F.xxhash64("turn"), F.lit(n_salts)).cast("int"))
    log = f"{base}/log"

    def append(batch: DataFrame, batch_id: int) -> None:
        compact(spark, log, batch_id - 1, n)  # batches before this one are committed
        lists = last_rows(batch, ["conv_id", "_salt"], n).select(*SALTED_SCHEMA.fieldNames())
        lists.withColumn("v", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{log}/v={batch_id}")

    q = (salted.writeStream.foreachBatch(append)
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return latest_per_session(spark, log, n)


class LogPart:
    """A folder of the log: batches ``first`` to ``last``, level 0 for one that
    a batch wrote, ``v=<batch>``, else ``v=<first>-<last>.<level>``."""

    def __init__(self, folder: str) -> None:
        self.folder = folder
        span, _, level = folder.removeprefix("v=").partition(".")
        first, _, last = span.partition("-")
        self.first, self.last, self.level = int(first), int(last or first), int(level or 0)

    def inside(self, other: "LogPart") -> bool:
        return self.folder != other.folder and other.first <= self.first and self.last <= other.last


def log_parts(spark: SparkSession, log: str) -> tuple[list[LogPart], list[LogPart]]:
    """(parts that a reader reads, in order; parts that a merged one replaces).
    A merged part counts once it is complete."""
    fs, p = hadoop_path(spark, log)
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    parts = [LogPart(n) for n in names if n.startswith("v=")]
    parts = [x for x in parts if x.level == 0 or path_exists(spark, f"{log}/{x.folder}/_SUCCESS")]
    live = [x for x in parts if not any(x.inside(y) for y in parts)]
    return sorted(live, key=lambda x: x.first), [x for x in parts if any(x.inside(y) for y in parts)]


def compact(spark: SparkSession, log: str, until: int, n: int = HISTORY_N) -> None:
    """Merge MERGE_PARTS neighbouring parts of one level, all of batches up to
    ``until``, into one of the next level, as long as there are any: of each
    (session, salt) only the last n rows stay. What an earlier call replaced
    is deleted now, so that a reader of that time has come to its end."""
    live, replaced = log_parts(spark, log)
    fs = hadoop_path(spark, log)[0]
    for part in replaced:
        fs.delete(hadoop_path(spark, f"{log}/{part.folder}")[1], True)
    while True:
        run: list[LogPart] = []
        for part in live:
            if part.last > until:
                break
            run = [*run, part] if run and run[-1].level == part.level else [part]
            if len(run) == MERGE_PARTS:
                break
        if len(run) < MERGE_PARTS:
            return
        merged = f"v={run[0].first}-{run[-1].last}.{run[0].level + 1}"
        rows = spark.read.schema(LOG_SCHEMA).parquet(*[f"{log}/{x.folder}" for x in run])
        last_rows(rows, ["conv_id", "_salt"], n).write.mode("overwrite").parquet(f"{log}/{merged}")
        live, _ = log_parts(spark, log)


def last_rows(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    """The n rows of the largest turns of each group (a partial window limit
    before the shuffle: a task sends at most n rows of a group)."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("turn")))
    return rows.withColumn("_rn", rank).filter(F.col("_rn") <= n).drop("_rn")


def latest_per_session(spark: SparkSession, log: str, n: int = HISTORY_N) -> DataFrame:
    """The last n entries of each session from the log, out of at most salts *
    n candidates of each of its parts."""
    live, _ = log_parts(spark, log)
    rows = (spark.read.schema(LOG_SCHEMA).parquet(*[f"{log}/{x.folder}" for x in live]) if live
            else spark.createDataFrame([], LOG_SCHEMA))
    return last_rows(rows, ["conv_id"], n).select(*HISTORY_COLS)


def history_last_n_stream(spark: SparkSession, sf_dir: str, n: int = HISTORY_N, name: str | None = None) -> DataFrame:
    """R4b over scored history rows (a table Spark derives from
    ``conversations``), which arrive in about FEED_BATCHES micro-batches, so
    that lists of several batches are merged."""
    from moodline.operators import reports as R
    model, _ = train_model(spark, sf_dir)
    feed = R.history_rows(model, read_keyed(spark, sf_dir, "conversations", ["conv_id", "turn"]))
    feed_path = scratch_path(spark, "streams/history_feed")
    # one file per partition of the feed: the stream reads them a few at a time
    feed.write.parquet(feed_path)
    n_files = len(spark.read.parquet(feed_path).inputFiles())
    stream = (spark.readStream.schema(feed.schema)
              .option("maxFilesPerTrigger", max(1, -(-n_files // FEED_BATCHES))).parquet(feed_path))
    return last_n_stream(stream, n, name)
