"""A1, A2, A5-A8, A10, M11, M12, M16 on hand-made scored rows."""

import pytest
from pyspark.sql import functions as F

from moodline.operators import reports as R
from moodline.operators.model_selection import mark_best

SCORED = "doc_id long, platform string, label string, predicted string, confidence double, " \
         "matches_original boolean"


def _scored(spark, data):
    df = spark.createDataFrame(data, "doc_id long, platform string, label string, predicted string, "
                                     "confidence double")
    return df.withColumn("matches_original",
                         F.coalesce(F.col("label") == F.col("predicted"), F.lit(False)))


DATA = [(1, "A", "Positive", "Positive", 0.9), (2, "A", "Negative", "Positive", 0.7),
        (3, "A", None, "Neutral", 0.6), (4, "B", "Neutral", "Neutral", 0.8),
        (5, None, "Positive", "Positive", 0.95), (6, "A", "Positive", "Error", 0.0)]


def test_platform_stats(spark):
    out = {r["platform"]: r for r in R.platform_stats(_scored(spark, DATA)).collect()}
    assert set(out) == {"A", "B"}           # null platform left out
    a, b = out["A"], out["B"]
    assert a["n_rows"] == 4 and a["n_labelled"] == 3
    assert a["avg_confidence"] == pytest.approx(round((0.9 + 0.7 + 0.6 + 0.0) / 4, 3))
    assert a["accuracy"] == 0.25 and a["labelled_accuracy"] == pytest.approx(0.333)
    assert b["std_confidence"] is None       # sample std of one row


def test_accuracy_counts_errors_and_unlabelled(spark):
    r = R.accuracy(_scored(spark, DATA)).first()
    assert (r["n_total"], r["n_match"]) == (6, 3)
    assert r["accuracy_pct"] == pytest.approx(50.0)
    empty = R.accuracy(_scored(spark, [])).first()
    assert empty["n_total"] == 0 and empty["accuracy_pct"] is None


def test_confusion_matrix_is_zero_filled_row_shares(spark):
    out = {r["label"]: r for r in R.confusion_matrix(_scored(spark, DATA)).collect()}
    assert set(out) == {"Positive", "Negative", "Neutral"}
    pos = out["Positive"]
    assert (pos["Positive"], pos["Error"], pos["Negative"], pos["Neutral"]) == \
        (pytest.approx(66.7), pytest.approx(33.3), 0.0, 0.0)
    assert out["Negative"]["Positive"] == 100.0


def test_mention_stats_and_empty_share(spark):
    df = spark.createDataFrame([("a@b",), ("@",), ("x",), (None,)], "text string")
    r = R.mention_stats(df).first()
    assert (r["total_rows"], r["rows_with_mentions"], r["pct_with_mentions"]) == (4, 2, 50.0)
    e = R.mention_stats(spark.createDataFrame([], "text string")).first()
    assert e["total_rows"] == 0 and e["pct_with_mentions"] is None


def test_stage_counts(spark):
    df = spark.createDataFrame([("t", " Positive "), ("t", "bogus"), (None, "Neutral"), ("t", None)],
                               "text string, raw_label string")
    r = R.stage_counts(df).first()
    assert (r["n_input"], r["n_complete"], r["n_known_label"]) == (4, 2, 1)


def test_best_epoch_first_max_wins(spark):
    acc = spark.createDataFrame([(1, 0.5), (2, 0.8), (3, 0.8), (4, 0.1)], "epoch int, val_accuracy double")
    assert [r["epoch"] for r in mark_best(acc).filter("is_best").collect()] == [2]


def test_best_epoch_all_zero_takes_last(spark):
    acc = spark.createDataFrame([(1, 0.0), (2, 0.0), (3, 0.0)], "epoch int, val_accuracy double")
    assert [r["epoch"] for r in mark_best(acc).filter("is_best").collect()] == [3]
