"""Scores kept across runs equal a fresh run and score new texts only."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from moodline.operators import naive_bayes as nb
from moodline.operators import score_store as SS
from moodline.operators import scorer as K
from moodline.operators.joins import materialize


@pytest.fixture(scope="module")
def model(spark):
    m = nb.fit(spark.createDataFrame([(1, "good fine day", 2), (2, "bad hate it", 0), (3, "ok day", 1)],
                                     "doc_id long, text string, label int"))
    m.weights = materialize(m.weights)
    return m


def docs(spark, ids):
    words = ["good", "bad", "ok", "fine", "hate", "unknown"]
    rows = [(i, None if i % 17 == 0 else "" if i % 19 == 0 else f"{words[i % 6]} {words[i // 6 % 6]} day" if i % 5 else "hot text")
            for i in ids]
    return spark.createDataFrame(rows, "doc_id long, text string")


def store(spark, tmp_path, **kw):
    return SS.ScoreStore(spark, "m", 1, f"{tmp_path}/{uuid.uuid4().hex}", **kw)


def fresh(model, df):
    rows = K.probabilities(model, K.gate_nonempty(df), "doc_id", "text", outer=True)
    return {r["doc_id"]: tuple(r[c] for c in K.PROB_COLS) for r in rows.collect()}


def values(run):
    rows = run.rows.collect()
    out = {r["doc_id"]: tuple(r[c] for c in K.PROB_COLS) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("bits", [1 << 24, 64])  # 64: nearly every hash is a false positive
def test_a_grown_table_equals_a_fresh_run(spark, tmp_path, model, bits):
    s = store(spark, tmp_path, bits=bits)
    one, two, three = docs(spark, range(20)), docs(spark, range(60)), docs(spark, range(30, 90))
    first = s.score(model, one)
    assert values(first) == fresh(model, one) and first.n_scored == first.n_texts
    known = {r["text"] for r in one.collect() if r["text"]}
    for df in (two, three, two):
        run = s.score(model, df)
        now = {r["text"] for r in df.collect() if r["text"]}
        assert values(run) == fresh(model, df)
        assert (run.n_texts, run.n_scored) == (len(now), len(now - known))
        assert run.n_looked_up >= len(now & known) and (bits == 64 or run.n_looked_up == len(now & known))
        reused = {r["doc_id"] for r in run.rows.filter("reused").collect()}
        assert reused == {r["doc_id"] for r in df.collect() if r["text"] in known}
        known |= now
    assert len(s.batches()) == 3 and s.scores().count() == len(known)  # the last run scored nothing


def test_texts_that_cannot_be_scored_are_remembered(spark, tmp_path, model):
    s, df = store(spark, tmp_path), spark.createDataFrame([(1, "zzz"), (2, "!!!"), (3, "good")], "doc_id long, text string")
    assert s.score(model, df).n_scored == 3
    again = s.score(model, df)
    assert again.n_scored == 0
    assert {r["doc_id"]: r["p_negative"] is None for r in again.rows.collect()} == {1: True, 2: True, 3: False}


def test_an_unfinished_batch_does_not_exist(spark, tmp_path, model):
    s, df = store(spark, tmp_path), docs(spark, range(12))
    s.score(model, df)
    from moodline.session import hadoop_path
    fs, manifest = hadoop_path(spark, f"{s.folder}/batch=1/manifest")
    fs.delete(manifest, True)
    run = s.score(model, df)
    assert run.n_scored == run.n_texts and s.batches() == [2] and values(run) == fresh(model, df)


def test_another_version_starts_anew_and_empty_tables(spark, tmp_path, model):
    root, df = str(tmp_path / "scores"), docs(spark, range(12))
    assert SS.ScoreStore(spark, "m", 1, root).score(model, df).n_scored > 0
    assert SS.ScoreStore(spark, "m", 1, root).score(model, df).n_scored == 0
    assert SS.ScoreStore(spark, "m", 2, root).score(model, df).n_scored > 0
    s = store(spark, tmp_path)
    assert s.score(model, df.filter("false")).rows.count() == 0 and s.batches() == []


def test_a_text_scored_by_two_runs_at_once_comes_back_once(spark, tmp_path, model):
    s, df = store(spark, tmp_path), docs(spark, range(12))
    s.score(model, df)
    s._write(s.scores([1]))
    assert values(s.score(model, df)) == fresh(model, df)


def test_the_filter_forgets_nothing_and_knows_little_else(spark):
    hashes = spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias("_th"), "id")
    words = np.zeros((1 << 16) // 64, np.uint64)
    for r in SS.bloom_words(hashes.filter("id < 2000").repartition(4), 1 << 16).collect():
        words[r["word"]] = np.uint64(r["mask"] % (1 << 64))
    got = SS.might_know(hashes, words).collect()
    assert all(r["_maybe"] for r in got if r["id"] < 2000)
    assert sum(r["_maybe"] for r in got if r["id"] >= 2000) < 30  # 33 bits a text


def test_shuffle_joins_beyond_the_bound(spark, tmp_path, model):
    spark.conf.set("moodline.broadcast.maxRows", "3")
    try:
        s = store(spark, tmp_path)
        s.score(model, docs(spark, range(30)))
        df = docs(spark, range(80))
        assert values(s.score(model, df)) == fresh(model, df)
    finally:
        spark.conf.unset("moodline.broadcast.maxRows")
