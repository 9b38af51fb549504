"""T5, T6, M1-M9, M15-M17 on hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from moodline.functions import labels as L
from moodline.functions import scoring as S
from moodline.operators import scorer as K


def test_label_codes(spark):
    raw = [" Positive  ", "NEGATIVE", "neutral", "very positive", "unsure", "", None, "\tNeutral\n"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, r string")
    got = [x[0] for x in df.orderBy("i").select(L.label_to_code(F.col("r"))).collect()]
    assert got == [2, 0, 1, None, None, None, None, 1]


def test_code_to_label(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (None,)], "c int")
    assert [r[0] for r in df.select(L.code_to_label(F.col("c"))).collect()] == \
        ["Negative", "Neutral", "Positive", None]


def _probs(spark, triples):
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(triples)],
                               "i int, n double, u double, p double")
    return df.orderBy("i")


def py_rule_a(n, u, p):
    if n > 0.4 and n > p:
        return "Negative"
    if p > 0.4 and p > n:
        return "Positive"
    return "Neutral"


def py_level(x):
    return "High" if x > 0.7 else "Moderate" if x > 0.4 else "Low"


TRIPLES = [(0.45, 0.50, 0.05), (0.45, 0.10, 0.45), (0.4, 0.2, 0.4), (0.7, 0.2, 0.1),
           (0.71, 0.2, 0.09), (0.2, 0.2, 0.6), (1 / 3, 1 / 3, 1 / 3), (float("nan"), 0.5, 0.5),
           (0.0, 1.0, 0.0), (0.41, 0.0, 0.59)]


def test_rules_levels_and_confidence(spark):
    df = _probs(spark, TRIPLES)
    n, u, p = F.col("n"), F.col("u"), F.col("p")
    out = df.select(S.sentiment_rule_a(n, u, p).alias("a"), S.sentiment_rule_b(n, u, p).alias("b"),
                    S.toxicity_level(n).alias("lvl"), S.confidence(n, u, p).alias("c")).collect()
    for (tn, tu, tp), r in zip(TRIPLES, out):
        assert r["a"] == py_rule_a(tn, tu, tp)
        assert r["lvl"] == py_level(tn)
        if not math.isnan(tn):
            vals = [tn, tu, tp]
            assert r["b"] == ["Negative", "Neutral", "Positive"][vals.index(max(vals))]
            s = sorted(vals, reverse=True)
            assert r["c"] == pytest.approx(s[0] / (s[0] + s[1]))
            assert 0.5 <= r["c"] <= 1.0
    # the two rules differ on (.45, .50, .05)
    assert (out[0]["a"], out[0]["b"]) == ("Negative", "Neutral")
    # strict thresholds: exactly .4 and .7 fall to the lower band
    assert out[2]["lvl"] == "Low" and out[3]["lvl"] == "Moderate"
    # NaN is never above a threshold (Spark alone would say it is)
    assert out[7]["lvl"] == "Low"


def test_softmax_and_cross_entropy(spark):
    logits = [(0.0, 0.0, 0.0, 0), (1000.0, -1000.0, 0.0, 1), (1.0, 2.0, 3.0, 2), (-5.0, 4.0, 4.0, 0)]
    df = spark.createDataFrame(logits, "a double, b double, c double, y int")
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    p0, p1, p2 = S.softmax3(a, b, c)
    out = df.select(p0.alias("p0"), p1.alias("p1"), p2.alias("p2"), S.argmax3(a, b, c).alias("k"),
                    S.cross_entropy(a, b, c, F.col("y")).alias("ce")).collect()
    for (la, lb, lc, y), r in zip(logits, out):
        m = max(la, lb, lc)
        e = [math.exp(v - m) for v in (la, lb, lc)]
        assert r["p0"] + r["p1"] + r["p2"] == pytest.approx(1.0)
        assert r["p0"] == pytest.approx(e[0] / sum(e))
        assert r["ce"] == pytest.approx(m + math.log(sum(e)) - (la, lb, lc)[y])
    assert [r["k"] for r in out] == [0, 0, 2, 1]  # first index on ties


def test_error_fallback(spark):
    df = spark.createDataFrame([("Positive", 0.9), (None, 0.7)], "pred string, conf double")
    probs = F.array(F.lit(0.1), F.lit(0.2), F.lit(0.7))
    out = df.select(K.error_fallback(F.col("pred"), F.col("conf"), probs).alias("r")).select("r.*").collect()
    assert tuple(out[0]) == ("Positive", 0.9, [0.1, 0.2, 0.7])
    assert tuple(out[1]) == ("Error", 0.0, [0.0, 0.0, 0.0])


def test_advice_covers_every_level(spark):
    df = spark.createDataFrame([("High",), ("Moderate",), ("Low",)], "toxicity_level string")
    got = K.with_advice(df).collect()
    assert len(got) == 3 and all(r["suggestions"] for r in got)


def test_raw_scores_map(spark):
    df = _probs(spark, [(0.0625, 0.0, 0.9375)])
    m = df.select(S.raw_scores_map(F.col("n"), F.col("u"), F.col("p")).alias("m")).first()["m"]
    assert m == {"Negative": "6.2%", "Neutral": "0.0%", "Positive": "93.8%"}
