"""Training by epochs (U3, A8-A10): a softmax classifier over hashed word
counts, fitted by AdamW with clipped gradients and a linearly falling rate,
validated after each epoch; the best epoch's weights are kept.

Rows are prepared once: label and word hashes, native. For each epoch they are
written in the epoch's own order (a bijection of the row numbers), cut into
``steps`` parts, without a shuffle; a step reads its part only. A step's
gradient is summed inside each task, then by hash bucket over the tasks. All
sums are over whole numbers (multiples of 1 / SCALE), so the weights do not
depend on the partitions. The driver holds the weights and the optimizer's
state: three numbers for each bucket and class, 2^18 buckets by default, however
large the table is. Steps an epoch are a parameter, so jobs do not grow with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodline.functions import text as T
from moodline.functions.scoring import argmax3
from moodline.operators.joins import materialize
from moodline.operators.model_selection import mark_best
from moodline.operators.sampling import BATCH_SIZE, epoch_place, global_index
from moodline.session import hadoop_path, scratch_path

N_CLASSES = 3
BUCKETS = 1 << 18
EPOCHS, STEPS = 3, 8
RATE, DECAY, CLIP = 0.05, 0.01, 1.0
BETA1, BETA2, EPS = 0.9, 0.999, 1e-8
SCALE = 1 << 24
#: Words handled together in a task.
SLICE_WORDS = 1 << 20
#: Numbers of the rows of a step's sums that are no bucket.
LOSS = -1


def features(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, label, words (hash bucket of each word of the text, in order);
    texts that are null are left out."""
    words = F.transform(T.tokens(F.col("text")), lambda t: F.pmod(F.xxhash64(t), F.lit(buckets)).cast("int"))
    return rows.filter(F.col("text").isNotNull()).select("doc_id", F.col("label").cast("int").alias("label"), words.alias("words"))


def forward(weights: np.ndarray, sizes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner of each word, value of a text's words, class probabilities) of
    texts with ``sizes`` words each, one after the other; the last line of
    ``weights`` is the bias."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    value = 1 / np.sqrt(np.maximum(sizes, 1))
    logits = np.stack([np.bincount(owner, weights[words, c], len(sizes)) * value + weights[-1, c]
                       for c in range(weights.shape[1])], axis=1)
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return owner, value, e / e.sum(axis=1, keepdims=True)


def _whole(x: np.ndarray) -> np.ndarray:
    return np.rint(x * SCALE).astype(np.int64)


def gradient(weights: np.ndarray, label: np.ndarray, sizes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lines, their whole-number sums): a line for each bucket that occurs and
    for the bias; line LOSS has the loss, the right predictions and the texts."""
    owner, value, p = forward(weights, sizes, words)
    own = p[np.arange(len(label)), label]
    right = p.argmax(axis=1) == label
    error = p.copy()
    error[np.arange(len(label)), label] -= 1
    lines, sums = [LOSS, len(weights) - 1], [
        [_whole(-np.log(np.maximum(own, 1e-300))).sum(), right.sum(), len(label)], _whole(error).sum(axis=0)]
    each = _whole(error * value[:, None])
    order = np.argsort(words, kind="stable")
    if len(order):
        ranked = words[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        return (np.concatenate([lines, ranked[first]]),
                np.concatenate([sums, np.add.reduceat(each[owner[order]], first, axis=0)]))
    return np.array(lines), np.array(sums)


@dataclass
class AdamW:
    """The optimizer: ``take`` one step with a gradient (mean over the texts)."""
    weights: np.ndarray
    total: int
    rate: float = RATE
    done: int = 0
    m: np.ndarray = field(init=False)
    v: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.m, self.v = np.zeros_like(self.weights), np.zeros_like(self.weights)

    def take(self, gradient: np.ndarray) -> None:
        norm = float(np.sqrt((gradient * gradient).sum()))
        gradient = gradient * min(1.0, CLIP / (norm + 1e-6))
        rate = self.rate * (self.total - self.done) / self.total
        self.done += 1
        self.m = BETA1 * self.m + (1 - BETA1) * gradient
        self.v = BETA2 * self.v + (1 - BETA2) * gradient * gradient
        change = (self.m / (1 - BETA1 ** self.done)) / (np.sqrt(self.v / (1 - BETA2 ** self.done)) + EPS)
        self.weights = self.weights * (1 - rate * DECAY) - rate * change


def _slices(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    """Columns ``names``, sizes and words, a bounded number of words at a time."""
    from moodline.operators.encoding import slices
    for whole in batches:
        size = np.diff(whole["words"].offsets.to_numpy())
        for at, stop in slices(size, SLICE_WORDS):
            part = whole.slice(at, stop - at)
            yield (*(part[n].to_numpy(zero_copy_only=False) for n in names), size[at:stop].astype(np.int64),
                   part["words"].flatten().to_numpy())


def step_sums(rows: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``gradient`` over all rows (label, words), summed by Spark."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(shared.value) + 1, N_CLASSES), np.int64)  # the last line is LOSS
        seen = np.zeros(len(total), bool)
        for label, sizes, words in _slices(batches, ["label"]):
            lines, sums = gradient(shared.value, label, sizes, words)
            total[lines] += sums
            seen[lines] = True
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.where(at == len(total) - 1, LOSS, at)), *(pa.array(total[at, c]) for c in range(N_CLASSES))],
            ["line", "g0", "g1", "g2"])

    try:
        table = (rows.select("label", "words").mapInArrow(run, "line long, g0 long, g1 long, g2 long")
                 .groupBy("line").agg(*[F.sum(f"g{c}").alias(f"g{c}") for c in range(N_CLASSES)]).toArrow())
    finally:
        shared.destroy()
    return table["line"].to_numpy(), np.stack([table[f"g{c}"].to_numpy() for c in range(N_CLASSES)], axis=1)


def scored(rows: DataFrame, weights: np.ndarray, keep: list[str]) -> DataFrame:
    """``keep`` (long columns), label, loss, correct, p_negative, p_neutral,
    p_positive of each row (label, words)."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)
    names = [*keep, "label", "loss", "correct", "p_negative", "p_neutral", "p_positive"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *cols, label, sizes, words in _slices(batches, [*keep, "label"]):
            _, _, p = forward(shared.value, sizes, words)
            loss = -np.log(np.maximum(p[np.arange(len(label)), label], 1e-300))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c.astype(np.int64)) for c in cols), pa.array(label.astype(np.int32)), pa.array(loss),
                 pa.array((p.argmax(axis=1) == label).astype(np.int32)), *(pa.array(p[:, c]) for c in range(N_CLASSES))], names)

    schema = "".join(f"{c} long, " for c in keep) + ("label int, loss double, correct int, p_negative double, "
                                                     "p_neutral double, p_positive double")
    return rows.select(*keep, "label", "words").mapInArrow(run, schema)


def validate(rows: DataFrame, weights: np.ndarray) -> tuple[float, float]:
    """(mean over batches of their mean loss, share of right predictions) of
    rows with a batch_id (A8, A9)."""
    per_batch = scored(rows, weights, ["batch_id"]).groupBy("batch_id").agg(
        F.avg("loss").alias("loss"), F.sum("correct").alias("correct"), F.count(F.lit(1)).alias("n"))
    got = per_batch.agg(F.avg("loss"), F.sum("correct") / F.sum("n")).first()
    return got[0] or 0.0, got[1] or 0.0


@dataclass
class Trained:
    weights: np.ndarray          # of the best epoch; the last line is the bias
    metrics: list[dict]          # a record for each epoch
    best: int                    # the epoch


def train(train_rows: DataFrame, val_rows: DataFrame, epochs: int = EPOCHS, steps: int = STEPS, buckets: int = BUCKETS,
          rate: float = RATE) -> Trained:
    """Fit on (doc_id, text, label) rows and judge on others. An epoch has at
    most as many steps as rows; without rows the weights stay 0."""
    spark = train_rows.sparkSession
    ready = materialize(global_index(features(train_rows, buckets), "doc_id").withColumn("idx", F.col("idx").cast("long")))
    judge = materialize(global_index(features(val_rows, buckets), "doc_id").withColumn(
        "batch_id", F.floor(F.col("idx") / BATCH_SIZE)).select("doc_id", "batch_id", "label", "words"))
    n = ready.count()
    steps = max(1, min(steps, n))
    model = AdamW(np.zeros((buckets + 1, N_CLASSES)), epochs * steps, rate)
    best, kept, metrics = 0.0, None, []
    for epoch in range(1, epochs + 1):
        path = scratch_path(spark, "epochs")
        step = F.call_function("div", epoch_place(F.col("idx"), n, epoch) * steps, F.lit(max(n, 1)))
        ready.withColumn("step", step).select("label", "words", "step").write.partitionBy("step").parquet(path)
        losses, right = [], 0
        for s in range(steps if n else 0):
            part = spark.read.schema("label int, words array<int>").parquet(f"{path}/step={s}")
            lines, sums = step_sums(part, model.weights)
            loss, correct, texts = sums[lines == LOSS][0]
            full = np.zeros_like(model.weights)
            full[lines[lines != LOSS]] = sums[lines != LOSS] / (SCALE * texts)
            model.take(full)
            losses.append(loss / (SCALE * texts))
            right += int(correct)
        fs, folder = hadoop_path(spark, path)
        fs.delete(folder, True)
        val_loss, accuracy = validate(judge, model.weights)
        metrics.append({"epoch": epoch, "n_steps": len(losses), "train_loss": float(np.mean(losses)) if losses else 0.0,
                        "train_accuracy": right / n if n else 0.0, "val_loss": val_loss, "val_accuracy": accuracy})
        if accuracy > best or kept is None:
            best, kept = max(best, accuracy), (epoch, model.weights)
    if best == 0:  # none is better than nothing: the last one
        kept = epochs, model.weights
    return Trained(kept[1], metrics, kept[0])


def metrics_table(spark, trained: Trained) -> DataFrame:
    """The records of the epochs with ``is_best`` (the A10 rule)."""
    table = spark.createDataFrame([tuple(m.values()) for m in trained.metrics],
                                  "epoch int, n_steps int, train_loss double, train_accuracy double, val_loss double, val_accuracy double")
    return mark_best(table)


def predict(rows: DataFrame, trained: Trained) -> DataFrame:
    """doc_id, label, predicted_code and class probabilities of (doc_id, text,
    label) rows, by the best epoch's weights."""
    out = scored(features(rows, len(trained.weights) - 1), trained.weights, ["doc_id"])
    p = [F.col(c) for c in ("p_negative", "p_neutral", "p_positive")]
    return out.select("doc_id", "label", argmax3(*p).alias("predicted_code"), *p)
