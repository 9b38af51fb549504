"""Exact stratified split, global index, batches of 32."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from moodline.operators import sampling as SM


def py_quotas(counts, f):
    n = sum(counts.values())
    t = math.ceil(round(f * n, 9))
    fl = {k: (c * t) // n for k, c in counts.items()}
    rem = sorted(counts, key=lambda k: (-((counts[k] * t) % n), k))
    extra = t - sum(fl.values())
    return {k: fl[k] + (1 if k in rem[:extra] else 0) for k in counts}


def _labels(spark, labels):
    return spark.createDataFrame([(i, y) for i, y in enumerate(labels)], "doc_id long, label int")


@pytest.mark.parametrize("counts", [{0: 1, 1: 10, 2: 60}, {0: 5, 1: 5, 2: 5}, {0: 1}, {0: 3, 2: 2}])
def test_split_exact_quotas(spark, counts):
    labels = [y for y, c in counts.items() for _ in range(c)]
    out = SM.stratified_split(_labels(spark, labels), "doc_id", "label", 0.2)
    got = {}
    for r in out.collect():
        got.setdefault(r["label"], []).append(r["split"])
    want = py_quotas(counts, 0.2)
    assert {k: v.count("test") for k, v in got.items()} == want
    assert out.count() == len(labels) == out.select("doc_id").distinct().count()


@pytest.mark.parametrize("counts, want", [
    ([299_999_999, 1, 4], [60_000_000, 0, 1]), ([10**12, 10**12 - 1, 3], None), ([7 * 10**12, 5, 5], None)])
def test_quotas_of_huge_classes_are_exact(spark, counts, want):
    table = spark.createDataFrame(list(enumerate(counts)), "label int, n_class long")
    got = {r["label"]: r["quota"] for r in SM.quotas_of_counts(table, "label", 0.2).collect()}
    total, n = (sum(counts) * 200_000 + 999_999) // 1_000_000, sum(counts)
    base = [c * total // n for c in counts]
    rest = sorted(range(len(counts)), key=lambda i: (-(counts[i] * total % n), i))
    for i in rest[:total - sum(base)]:
        base[i] += 1
    assert [got[i] for i in range(len(counts))] == base and want in (None, base)


def test_split_is_first_rows_in_order_key(spark):
    labels = [0] * 40 + [1] * 25
    out = SM.stratified_split(_labels(spark, labels), "doc_id", "label", 0.2).withColumn(
        "ok", SM.order_key(F.col("doc_id")))
    for y in (0, 1):
        part = sorted((r["ok"], r["doc_id"], r["split"]) for r in out.filter(F.col("label") == y).collect())
        splits = [s for _, _, s in part]
        k = splits.count("test")
        assert splits == ["test"] * k + ["train"] * (len(splits) - k)


def test_null_labels_are_left_out(spark):
    df = spark.createDataFrame([(1, 0), (2, None), (3, 1)], "doc_id long, label int")
    assert SM.stratified_split(df, "doc_id", "label").count() == 2


@pytest.mark.parametrize("n", [0, 31, 32, 33, 100])
def test_global_index_and_batches(spark, n):
    df = spark.createDataFrame([(i * 7,) for i in range(n)], "doc_id long")
    out = SM.with_batches(df, "doc_id", 32).collect()
    assert sorted(r["idx"] for r in out) == list(range(n))
    per = {}
    for r in out:
        per[r["batch_id"]] = per.get(r["batch_id"], 0) + 1
    assert sorted(per) == list(range(math.ceil(n / 32)))
    assert all(v == 32 for k, v in per.items() if k < n // 32)
    # the order is the order key, independent of partitioning
    order = [r["doc_id"] for r in sorted(out, key=lambda r: r["idx"])]
    keyed = spark.createDataFrame([(d,) for d in order], "doc_id long").select(
        "doc_id", SM.order_key(F.col("doc_id"), SM.SHUFFLE_SEED).alias("ok")).collect()
    assert order == [r["doc_id"] for r in sorted(keyed, key=lambda r: (r["ok"], r["doc_id"]))]


@settings(max_examples=4, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=80))
def test_split_quota_property(spark, labels):
    out = SM.stratified_split(_labels(spark, labels), "doc_id", "label", 0.2).collect()
    counts = {y: labels.count(y) for y in set(labels)}
    got = {y: sum(1 for r in out if r["label"] == y and r["split"] == "test") for y in counts}
    assert got == py_quotas(counts, 0.2)
    assert sum(got.values()) == math.ceil(round(0.2 * len(labels), 9))


def test_first_n_equals_order_by_limit_on_skewed_keys(spark):
    from moodline.operators.sampling import first_n
    # a dense cluster of keys, a few huge outliers and negative keys: the cut
    # range holds many keys, so the range is cut again (max_rows=3)
    keys = list(range(1000, 1400)) + [10**15, 2 * 10**15, -5, -(10**12)] + [None]
    df = spark.createDataFrame([(k, f"r{k}") for k in keys], "k long, v string")
    want_all = sorted(k for k in keys if k is not None)
    for n in (1, 2, 3, 7, 50, 403, 404, 500):
        got = [r["k"] for r in first_n(df, "k", n, max_rows=3).collect()]
        assert got == want_all[:n], n
    assert first_n(df.filter("k is null"), "k", 5).count() == 0
    # the whole long range: offsets beyond 2^63 do not overflow
    ext = [-(2**63), 2**63 - 1, 0, 1, 2, -1]
    dfx = spark.createDataFrame([(k,) for k in ext], "k long")
    for n in (1, 3, 6):
        assert [r["k"] for r in first_n(dfx, "k", n, max_rows=1).collect()] == sorted(ext)[:n]


def test_epoch_places_are_permutations_of_every_size(spark):
    from moodline.operators.sampling import epoch_domain, epoch_place
    for n in (1, 2, 3, 5, 31, 32, 33, 97, 1000, 4097):
        a, b = epoch_domain(n)
        assert a * b >= n and a * b - n < max(a, 2)
        rows = spark.range(n).select("id", *[epoch_place(F.col("id"), n, e).alias(f"e{e}") for e in (1, 2)]).collect()
        for e in ("e1", "e2"):
            assert sorted(r[e] for r in rows) == list(range(n)), n
    orders = [[r[e] for r in rows] for e in ("e1", "e2")]
    same = sum(x == y for x, y in zip(*orders))
    assert same < 20 and sum(i == x for i, x in enumerate(orders[0])) < 20
    # neighbours do not stay neighbours
    near = sum(abs(x - y) <= 32 for x, y in zip(orders[0], orders[0][1:]))
    assert near < 4097 * 0.05


def test_epoch_places_of_a_very_large_range_need_no_other_row(spark):
    from moodline.operators.sampling import epoch_place
    n = 10**13 + 7
    rows = spark.createDataFrame([(i,) for i in (0, 1, 2, n - 2, n - 1)], "id long").select(
        epoch_place(F.col("id"), n, 1).alias("p")).collect()
    places = [r["p"] for r in rows]
    assert len(set(places)) == 5 and all(0 <= p < n for p in places)


def test_a_new_epoch_needs_no_new_shuffle(spark):
    from moodline.operators.sampling import with_epoch_batches
    df = spark.range(500).withColumnRenamed("id", "doc_id")
    plans = [with_epoch_batches(df, "doc_id", e, n=500)._jdf.queryExecution().executedPlan().toString() for e in (1, 9)]
    assert plans[0].count("Exchange") == plans[1].count("Exchange")
    out = with_epoch_batches(df, "doc_id", 3)
    per = out.groupBy("epoch", "batch_id").count().collect()
    assert sorted((r["epoch"], r["batch_id"], r["count"]) for r in per) == [
        (e, b, 32 if b < 15 else 20) for e in (1, 2, 3) for b in range(16)]
    assert with_epoch_batches(df.filter("false"), "doc_id", 2).count() == 0
