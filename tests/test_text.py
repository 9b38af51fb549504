"""T1-T4, T7, T8, P6 on hand-made rows and random strings, checked against
Python's own str / re behaviour."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from moodline.functions import text as T

MENTION_RE = re.compile(r"@\w+\s*")


def py_remove_mentions(s):
    if s is None:
        return None
    return MENTION_RE.sub("", s).strip()


EDGE = ["@a hello", "x @a@b y", "me@host.com", "@", "@é_9 z", "@a", None,
        "@a tail", "@a\u001ctail", "  padded @user  ", "mid @x_1, y", "tab\t@u\tend",
        "ünïcödé @ünï text", "emoji 😀 @e1 x", "", "   "]


def _apply(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r["o"] for r in df.select("i", fn(F.col("s")).alias("o")).orderBy("i").collect()]


def test_remove_mentions_edge_rows(spark):
    assert _apply(spark, EDGE, T.remove_mentions) == [py_remove_mentions(v) for v in EDGE]


def test_remove_mentions_examples(spark):
    got = dict(zip(EDGE, _apply(spark, EDGE, T.remove_mentions)))
    assert got["@a hello"] == "hello"
    assert got["me@host.com"] == "me.com"
    assert got["@"] == "@"
    assert got["@a"] == ""
    assert got[None] is None


def test_strip_is_python_strip(spark):
    vals = [" a ", " b ", "\x1cc\x1f", "\u0085d\u0085", "\te\n", "x", "", None, " ​ "]
    assert _apply(spark, vals, T.py_strip) == [None if v is None else v.strip() for v in vals]


def test_strip_is_linear_in_inner_blanks(spark):
    import time
    df = spark.createDataFrame([("a" + " " * 1_000_000 + "b  ",)], "t string")
    df.select(T.py_strip(F.col("t"))).collect()
    t = time.time()
    out = df.select(T.py_strip(F.col("t"))).first()[0]
    assert len(out) == 1_000_002 and time.time() - t < 1


def test_has_mention_null_is_false(spark):
    assert _apply(spark, ["a@b", "@", "none", None], T.has_mention) == [True, True, False, False]


def test_capitalize_lowers_the_rest(spark):
    vals = ["positive", "NEGATIVE", " neutral", "very POSITIVE", "", None, "éA"]
    assert _apply(spark, vals, T.capitalize) == [None if v is None else v.capitalize() for v in vals]


def test_preview_counts_code_points(spark):
    vals = ["a" * 49, "a" * 50, "a" * 51, "b" * 49 + "😀" + "c", None]
    want = [None if v is None else (v[:50] + "..." if len(v) > 50 else v) for v in vals]
    assert _apply(spark, vals, T.preview) == want


def test_percent_text_rounds_like_python(spark):
    ps = [0.0625, 0.9995, 0.5, 0.123456, 1.0, 0.0]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "i int, p double")
    got = [r[0] for r in df.orderBy("i").select(T.percent_text(F.col("p"))).collect()]
    assert got == [f"{p:.1%}" for p in ps]
    assert got[0] == "6.2%" and got[1] == "100.0%"


def test_tokens_are_unicode_word_runs(spark):
    vals = ["Hello, WORLD! héllo_2", "a-b c", "", None]
    got = _apply(spark, vals, T.tokens)
    assert got[:3] == [re.findall(r"\w+", v.lower()) for v in vals[:3]]
    assert got[3] is None


ALPHABET = st.sampled_from(list("ab _@.,\t\n") + [" ", " ", "\x1c", "é", "9", "😀", "\u0085"])


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=20), min_size=1, max_size=60))
def test_remove_mentions_property(spark, texts):
    assert _apply(spark, texts, T.remove_mentions) == [py_remove_mentions(t) for t in texts]
    assert _apply(spark, texts, T.py_strip) == [t.strip() for t in texts]


def test_has_content_edge_rows(spark):
    got = _apply(spark, EDGE, T.has_content)
    want = [v is not None and py_remove_mentions(v) != "" for v in EDGE]
    assert got == want


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=12), min_size=1, max_size=80))
def test_has_content_property(spark, texts):
    # has_content(t) <=> the clean-up leaves a non-empty text
    assert _apply(spark, texts, T.has_content) == [py_remove_mentions(t) != "" for t in texts]
