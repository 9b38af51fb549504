"""Source divergence audit against brute force."""

import re
from collections import Counter, defaultdict

import helpers
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from moodline.llm import divergence as D

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def brute(rows, min_docs=10, top=10):
    counts, df = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(LOWER))
        counts[(lang, source)].update(terms)
        df[lang].update(set(terms))
    out = set()
    for lang in df:
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        sources = sorted(s for x, s in counts if x == lang)
        whole = Counter()
        for s in sources:
            whole.update(counts[(lang, s)])

        def price(c, kept=kept):
            size = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // size for t in kept}

        def gap(x, y):
            return (x - y) ** 2 // (x + y)

        q = price(whole)
        p = {s: price(counts[(lang, s)]) for s in sources}
        for s in sources:
            pairs = [(sum(gap(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(gap(p[s][t], q[t]), t) for t in kept if counts[(lang, s)][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                for rank, (value, item) in enumerate(found, 1):
                    if part == "pair" or rank <= top:
                        out.add((lang, s, part, item, value, rank))
    return out


def rows_of(df):
    return [(r["text"], r["lang"], r["source"]) for r in df.select("text", "lang", "source").collect()]


def check(df, **kw):
    got = [tuple(r) for r in D.audit(df, **kw).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got))
    want = brute(rows_of(df), **{k: v for k, v in kw.items() if k in ("min_docs", "top")})
    assert set(got) == want
    return got


def invented(spark, n=120, sources=7):
    rows = []
    for i in range(n):
        lang = ["en", "de", None][i % 3]
        source = None if i % 11 == 0 else f"s{i % sources if i % 2 else 0}"
        words = [f"{'wxyz'[(i * j) % 4]}{chr(97 + (i * 7 + j * j) % 26)}" for j in range(i % 23)]
        rows.append((i, " ".join(words) + (" Ünï-漢字 It's" if i % 5 == 0 else ""), lang, source, 0))
    return spark.createDataFrame(rows, helpers.SCHEMA)


@pytest.mark.parametrize("kw", [{}, {"min_docs": 2}, {"min_docs": 3, "top": 2, "block": 2, "bucket_terms": 5},
                                {"min_docs": 1, "block": 1, "bucket_terms": 1}])
def test_equals_brute_force(spark, kw):
    assert check(invented(spark).repartition(4), **kw)


def test_awkward_rows_clashing_columns_and_repeats(spark):
    docs = helpers.clashing(spark)
    docs = docs.withColumns({c: F.lit("x") for c in ("term", "n", "docs", "pos", "total", "bucket", "value", "part", "item")})
    check(docs.unionByName(docs), min_docs=2)
    check(docs)  # no kept term: pairs of value 0


def test_empty_table(spark):
    assert D.audit(helpers.empty(spark)).collect() == []


def test_shuffle_join_of_the_totals(spark):
    spark.conf.set("moodline.broadcast.maxRows", "2")
    try:
        check(invented(spark), min_docs=2)
    finally:
        spark.conf.unset("moodline.broadcast.maxRows")


def test_long_texts_are_cut_at_separators(spark, monkeypatch):
    text = ("Alpha beta, " * 30 + "x" * 100).encode()
    whole = text.translate(D._TERM_BYTES).split()
    for size in (1, 7, 64, 10_000):
        monkeypatch.setattr(D, "PIECE_BYTES", size)
        assert [w for p in D.pieces(text) for w in p] == whole
    monkeypatch.undo()
    long = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(600_000))
    rows = [(i, long if i < 2 else "wab wcd", "en", f"s{i % 3}", 0) for i in range(12)]
    check(spark.createDataFrame(rows, helpers.SCHEMA), min_docs=2)


def test_a_full_table_of_terms_is_handed_on_early(spark, monkeypatch):
    monkeypatch.setattr(D, "TASK_TERMS", 16)
    check(invented(spark).coalesce(1), min_docs=2)


def test_counts_beyond_64_bits():
    got = D.prices(np.array([10**15, 0, 10**18]), 2 * 10**18, 3)
    assert got.tolist() == [1 + 10**9 * (c + 2) // (2 * 10**18 + 6) for c in (10**15, 0, 10**18)]


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 4000)), st.sets(st.integers(0, 4000)), st.integers(1, 40))
def test_galloping_intersection(a, b, gallop):
    old, D.GALLOP = D.GALLOP, gallop
    try:
        x, y = np.array(sorted(a), np.int64), np.array(sorted(b), np.int64)
        i, j = D.intersect(x, y)
    finally:
        D.GALLOP = old
    assert x[i].tolist() == sorted(a & b) == y[j].tolist()
