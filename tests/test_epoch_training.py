"""Training by epochs against a plain run over dense arrays."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from moodline.operators import epoch_training as T
from moodline.operators import sampling as SM

WORDS = {0: ["bad", "hate", "awful"], 1: ["ok", "table", "chair"], 2: ["good", "love", "fine"]}


def posts(spark, n, seed=1, partitions=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = rng.randrange(3)
        words = rng.choices(WORDS[y] + ["the", "and", "of"], k=rng.randrange(9)) + rng.choices(["x", "y"], k=rng.randrange(3))
        rows.append((i, " ".join(words), y))
    return spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(partitions)


def dense(spark, train, val, epochs, steps, buckets, rate):
    """The same fit over one dense matrix (bias as the last column)."""
    def matrix(df):
        rows = sorted(T.features(df, buckets).collect(), key=lambda r: r["doc_id"])
        x = np.zeros((len(rows), buckets + 1))
        for i, r in enumerate(rows):
            for w in r["words"]:
                x[i, w] += 1
        size = x.sum(axis=1, keepdims=True)
        x /= np.sqrt(np.maximum(size, 1))
        x[:, -1] = 1
        return [r["doc_id"] for r in rows], x, np.array([r["label"] for r in rows])

    ids, x, y = matrix(train)
    n = len(y)
    idx = {r["doc_id"]: r["idx"] for r in SM.global_index(train.select("doc_id"), "doc_id").collect()}
    w = np.zeros((buckets + 1, 3))
    m, v, t, losses = np.zeros_like(w), np.zeros_like(w), 0, []
    for epoch in range(1, epochs + 1):
        table = spark.createDataFrame([(d, idx[d]) for d in ids], "doc_id long, idx long").select(
            "doc_id", SM.epoch_place(F.col("idx"), n, epoch).alias("p")).collect()
        place = {r["doc_id"]: r["p"] for r in table}
        step = np.array([place[d] * steps // n for d in ids])
        per_step = []
        for s in range(steps):
            a, b = x[step == s], y[step == s]
            z = a @ w
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            per_step.append(-np.log(p[np.arange(len(b)), b]).mean())
            e = p - np.eye(3)[b]
            g = a.T @ e / len(b)
            g *= min(1.0, 1.0 / (np.sqrt((g * g).sum()) + 1e-6))
            lr = rate * (epochs * steps - t) / (epochs * steps)
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - lr * 0.01 * w - lr * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        losses.append(np.mean(per_step))
    _, xv, yv = matrix(val)
    return w, losses, ((xv @ w).argmax(axis=1) == yv).mean()


def test_weights_equal_a_plain_run(spark):
    train, val = posts(spark, 120), posts(spark, 40, seed=2)
    got = T.train(train, val, epochs=3, steps=4, buckets=64, rate=0.1)
    weights, losses, accuracy = dense(spark, train, val, 3, 4, 64, 0.1)
    assert np.allclose([m["train_loss"] for m in got.metrics], losses, atol=1e-4)
    assert got.metrics[-1]["val_accuracy"] == pytest.approx(accuracy, abs=0.03)
    if got.best == 3:
        assert np.abs(got.weights - weights).max() < 1e-2
    assert losses[0] > losses[1] > losses[2]


def test_partitions_change_nothing_at_all(spark):
    runs = [T.train(posts(spark, 90, partitions=p), posts(spark, 30, seed=2), epochs=2, steps=3, buckets=32)
            for p in (1, 5)]
    assert (runs[0].weights == runs[1].weights).all()
    for a, b in zip(runs[0].metrics, runs[1].metrics):
        assert a["train_loss"] == b["train_loss"] and a["train_accuracy"] == b["train_accuracy"]


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(3)
    w = rng.normal(0, 0.5, (9, 3))
    sizes, words, label = np.array([3, 0, 2, 4]), rng.integers(0, 8, 9), np.array([0, 1, 2, 1])

    def loss(w):
        _, _, p = T.forward(w, sizes, words)
        return -np.log(p[np.arange(4), label]).sum()
    lines, sums = T.gradient(w, label, sizes, words)
    full = np.zeros_like(w)
    full[lines[lines != T.LOSS]] = sums[lines != T.LOSS] / T.SCALE
    for i, c in [(0, 0), (3, 1), (8, 2), (5, 0)]:
        moved = w.copy()
        moved[i, c] += 1e-5
        assert (loss(moved) - loss(w)) / 1e-5 == pytest.approx(full[i, c], abs=1e-3)
    assert sums[lines == T.LOSS][0][0] / T.SCALE == pytest.approx(loss(w), abs=1e-5)


def test_best_epoch_and_predictions(spark):
    train, val = posts(spark, 150), posts(spark, 60, seed=5)
    got = T.train(train, val, epochs=4, steps=5, buckets=256, rate=0.2)
    best = [r["epoch"] for r in T.metrics_table(spark, got).collect() if r["is_best"]]
    accuracy = [m["val_accuracy"] for m in got.metrics]
    assert best == [got.best] == [accuracy.index(max(accuracy)) + 1] and max(accuracy) > 0.8
    rows = T.predict(val, got).collect()
    assert len(rows) == 60
    assert sum(r["predicted_code"] == r["label"] for r in rows) / 60 == pytest.approx(max(accuracy))
    for r in rows:
        p = [r["p_negative"], r["p_neutral"], r["p_positive"]]
        assert sum(p) == pytest.approx(1) and p[r["predicted_code"]] == max(p)


def test_awkward_and_empty_input(spark):
    schema = "doc_id long, text string, label int"
    empty = spark.createDataFrame([], schema)
    got = T.train(empty, empty, epochs=2, steps=2, buckets=8)
    assert not got.weights.any() and got.best == 2 and [m["n_steps"] for m in got.metrics] == [0, 0]
    odd = spark.createDataFrame([(1, None, 0), (2, "", 1), (3, "!!!", 2), (4, "word " * 50_000, 0), (4, "word", 0)], schema)
    got = T.train(odd, odd, epochs=1, steps=8, buckets=8)
    assert got.metrics[0]["n_steps"] == 4 and np.isfinite(got.weights).all()
    assert len(T.predict(odd, got).collect()) == 4
