"""Hard-negative mining against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from moodline.llm import negatives as N

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, n_pos=5, n_neg=10, every=100):
    taking = []
    for vec_id, vec, label in rows:
        if label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        taking.append((vec_id, [max(-2**53, min(2**53, math.floor(256 * float(np.float32(x))))) for x in vec], label))
    out = Counter()
    for i, (a, va, la) in enumerate(taking):
        if a is None or a % every:
            continue
        scored = sorted(((sum(x * y for x, y in zip(va, v, strict=False)), j, r, lab)
                         for j, (r, v, lab) in enumerate(taking) if j != i),
                        key=lambda t: (-t[0], t[2] is None, t[2] or 0, t[1]))
        for p_score, _, p, _ in [t for t in scored if t[3] == la][:n_pos]:
            fit = [t for t in scored if t[3] != la and 30 * p_score <= 100 * t[0] <= 90 * p_score][:n_neg]
            for rank, (score, _, r, _) in enumerate(fit, 1):
                out[(a, p, rank, r, max(-2**63, min(2**63 - 1, p_score)), max(-2**63, min(2**63 - 1, score)))] += 1
    return out


def result(df, **kw):
    return Counter(tuple(r) for r in N.mine_negatives(df, **kw).collect())


def random_rows(n, dims=6, seed=1, spread=0.5):
    rng = random.Random(seed)
    centers = [[rng.gauss(0, spread) for _ in range(dims)] for _ in range(4)]
    out = []
    for i in range(n):
        c = rng.randrange(4)
        out.append((i, [x * 0.8 + 0.3 + rng.gauss(0, 0.2) for x in centers[c]], c))
    return out


@pytest.mark.parametrize("bits", [2, 8, 12, 20, 30, 53])
def test_packed_products_are_exact(bits):
    rng = np.random.default_rng(bits)
    for dims in (1, 3, 64):
        a = rng.integers(-(1 << bits), (1 << bits) + 1, (5, dims))
        b = rng.integers(-(1 << bits), (1 << bits) + 1, (7, dims))
        want = [[sum(x * y for x, y in zip(r, c, strict=True)) for c in b.tolist()] for r in a.tolist()]
        assert N.packed_scores(a, b).tolist() == want


def test_extreme_fields_do_not_carry():
    for m in (1, 160, 4095, 2**20):
        a = np.array([[m] * 64, [-m] * 64, [0] * 64])
        got = N.packed_scores(a, a)
        assert got.tolist() == [[64 * m * m, -64 * m * m, 0], [-64 * m * m, 64 * m * m, 0], [0, 0, 0]]


def test_equals_brute_force(spark):
    rows = random_rows(700)
    assert len(brute(rows)) > 100
    assert result(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows)


def test_chunks_and_arrival_order_give_the_same(spark):
    rows = random_rows(400, seed=3)
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, 3, 4, 20)
    kw = {"n_positives": 3, "n_negatives": 4, "anchor_every": 20}
    assert result(df.repartition(7), **kw) == want
    assert result(df.orderBy(F.desc("vec_id")), chunk_bytes=8 * 9 * 6, **kw) == want


def test_ties_nulls_lengths_repeats(spark):
    rows = random_rows(150, seed=5)
    inf, nan = float("inf"), float("nan")
    rows += [(200, [1.0, 1.0], 1), (200, [1.0, 1.0], 1), (300, [0.5] * 9, 1), (300, [0.25] * 3, 2), (None, [0.5] * 6, 1),
             (None, [0.4] * 6, 3), (400, [], 2), (500, None, 1), (600, [1.0, None], 1), (700, [nan, 1.0], 1),
             (800, [inf, 1.0], 1), (900, [1.0, -inf], 1), (1000, [0.5] * 6, None), (-100, [0.3] * 6, 0)]
    rows += [(2000 + i, [0.5] * 6, i % 3) for i in range(60)]  # a block of equal vectors
    assert result(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute(rows)


def test_very_large_components_stay_exact(spark):
    rows = random_rows(120, seed=7)
    rows += [(1000, [1e30, 1.0], 1), (1100, [1e30, 2.0], 1), (1201, [5e14, 1.0], 2), (1300, [-1e30] * 4, 0),
             (1401, [-9e14] * 2, 0)]
    got = result(spark.createDataFrame(rows, SCHEMA).repartition(2))
    assert got == brute(rows) and max(abs(r[4]) for r in got) > 1 << 40


def test_empty_tables_and_clashing_columns(spark):
    assert result(spark.createDataFrame([], SCHEMA)) == Counter()
    assert result(spark.createDataFrame([(1, [1.0], 1)], SCHEMA)) == Counter()
    assert result(spark.createDataFrame([(100, [], 1), (2, [], 2)], SCHEMA)) == Counter()
    rows = random_rows(120, seed=9)
    df = spark.createDataFrame(rows, SCHEMA)
    extra = df.withColumns({c: F.lit("x") for c in ("row", "comps", "score", "rank", "a", "j", "anchor_id")})
    assert result(extra) == brute(rows)


def test_long_vectors(spark):
    rng = random.Random(2)
    rows = [(i * 10, [rng.random() for _ in range(5000)], i % 3) for i in range(40)]
    assert result(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
