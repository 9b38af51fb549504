"""U1 naive Bayes against a plain-Python computation; K1 = K2 = K3; the
checked lookup join beyond its broadcast bound; the model store."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from moodline.operators import naive_bayes as nb
from moodline.operators import scorer as K
from moodline.operators import batch_predict as B
from moodline.operators.joins import checked_lookup_join, materialize
from moodline.sources.model_store import ModelStore

TRAIN = [(1, "good great fine day", 2), (2, "bad awful hate", 0), (3, "ok fine meh", 1),
         (4, "great love good good", 2), (5, "hate bad bad day", 0), (6, "meh ok day", 1),
         (7, "love it", 2)]
TEST = [(10, "good day"), (11, "awful hate it"), (12, "meh"), (13, "unknownword"), (14, "Good, GOOD!"),
        (15, "good day")]


def py_model(train, alpha=1.0):
    occ = {c: Counter() for c in range(3)}
    docs = Counter()
    for _, text, y in train:
        occ[y].update(re.findall(r"\w+", text.lower()))
        docs[y] += 1
    vocab = set().union(*[set(o) for o in occ.values()])
    tot = {c: sum(occ[c].values()) for c in range(3)}
    w = {t: [round(math.log((occ[c][t] + alpha) / (tot[c] + alpha * len(vocab))) * 1e6) for c in range(3)]
         for t in vocab}
    n = sum(docs.values())
    pri = [math.log((docs[c] + alpha) / (n + 3 * alpha)) for c in range(3)]
    return w, pri


def py_probs(w, pri, text):
    toks = [t for t in re.findall(r"\w+", text.lower()) if t in w]
    if not toks:
        return None
    lg = [pri[c] + sum(w[t][c] for t in toks) / 1e6 / math.sqrt(len(toks)) for c in range(3)]
    m = max(lg)
    e = [math.exp(x - m) for x in lg]
    return [x / sum(e) for x in e]


@pytest.fixture(scope="module")
def model(spark):
    train = spark.createDataFrame(TRAIN, "doc_id long, text string, label int")
    m = nb.fit(train)
    m.weights = materialize(m.weights)
    return m


@pytest.fixture(scope="module")
def test_df(spark):
    return spark.createDataFrame(TEST, "doc_id long, text string")


def test_weights_match_python(model):
    w, _ = py_model(TRAIN)
    got = {r["token"]: [r["wq0"], r["wq1"], r["wq2"]] for r in model.weights.collect()}
    assert got == w
    assert model.vocab_size == len(w)


def test_probabilities_match_python(model, test_df):
    w, pri = py_model(TRAIN)
    got = {r["doc_id"]: [r["p_negative"], r["p_neutral"], r["p_positive"]]
           for r in K.probabilities(model, test_df).collect()}
    for doc_id, text in TEST:
        want = py_probs(w, pri, text)
        if want is None:
            assert doc_id not in got
        else:
            assert got[doc_id] == pytest.approx(want, abs=1e-9)


def test_batch_udf_and_distinct_equal_native(model, test_df):
    native = sorted(tuple(r) for r in K.probabilities(model, test_df).select(
        "doc_id", "p_negative", "p_neutral", "p_positive").collect())
    udf = sorted(tuple(r) for r in K.probabilities(model, test_df, in_place=True).select(
        "doc_id", "p_negative", "p_neutral", "p_positive").collect())
    dist = sorted(tuple(r) for r in K.score_distinct(model, test_df).select(
        "doc_id", "p_negative", "p_neutral", "p_positive").collect())
    assert native == udf == dist


@pytest.mark.parametrize("bound", [1000, 40, 5])
def test_score_distinct_with_a_hot_copy_equals_native(model, spark, bound):
    # one text fills a third of the rows; bounds pick each strategy: semi-join
    # with representatives (1000), anti-join with copies (40), shuffle (5)
    from moodline.operators.joins import BROADCAST_ROWS_CONF
    texts = [t for _, t in TEST if t != "unknownword"]
    rows = [(i, "bad awful service" if i % 3 == 0 else texts[i % len(texts)] + f" x{i % 29}")
            for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    native = sorted(tuple(r) for r in K.probabilities(model, df).select(
        "doc_id", "p_negative", "p_neutral", "p_positive").collect())
    spark.conf.set(BROADCAST_ROWS_CONF, str(bound))
    try:
        dist = sorted(tuple(r) for r in K.score_distinct(model, df).select(
            "doc_id", "p_negative", "p_neutral", "p_positive").collect())
    finally:
        spark.conf.unset(BROADCAST_ROWS_CONF)
    assert dist == native and len(native) == 90


def test_unscorable_rows_get_error(model, spark):
    df = spark.createDataFrame([(1, "unknownword"), (2, None), (3, ""), (4, "good")], "doc_id long, text string")
    got = {r["doc_id"]: r["sentiment"] for r in K.score_with_errors(model, df).collect()}
    assert got == {1: "Error", 2: "Error", 3: "Error", 4: "Positive"}


def test_in_place_scorer_keeps_other_rows_when_one_text_fails(model, test_df):
    def fails_on_hate(tokens, vocabulary, weights):
        if "hate" in tokens.flatten().to_pylist():
            raise ValueError("cannot score this text")
        return B.token_sums(tokens, vocabulary, weights)

    got = {r["doc_id"]: r for r in B.sums_in_place(model, test_df, ["doc_id"], scorer=fails_on_hate).collect()}
    want = {r["doc_id"]: r for r in B.sums_in_place(model, test_df, ["doc_id"]).collect()}
    assert got[11]["s0"] is None and got[11]["n_known"] is None
    assert want[11]["n_known"] == 3
    assert all(got[i] == want[i] for i in want if i != 11)


def test_in_place_scorer_on_null_empty_and_unknown_texts(model, spark):
    df = spark.createDataFrame([(1, "unknownword"), (2, None), (3, ""), (4, "good")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_known"] for r in B.sums_in_place(model, df, ["doc_id"]).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 1}
    outer = K.probabilities(model, df, outer=True, in_place=True).collect()
    assert sorted((r["doc_id"], r["n_known"], r["p_negative"] is None) for r in outer) == [
        (1, 0, True), (2, 0, True), (3, 0, True), (4, 1, False)]


@pytest.fixture
def no_auto_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


@pytest.mark.parametrize("bound", [1, 2, 4])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_join_beyond_the_bound_equals_plain_join(spark, no_auto_broadcast, monkeypatch, bound, how):
    from moodline.operators import joins
    monkeypatch.setattr(joins.hot_keys, "__defaults__", (3,))  # keys with over a third of the rows are hot
    big = spark.createDataFrame(
        [(i, None if i % 10 == 0 else "unseen" if i % 2 else f"t{i % 9}") for i in range(300)], "i int, token string")
    small = materialize(spark.createDataFrame([(f"t{k}", k) for k in range(8)], "token string, w int"))
    want = sorted(map(tuple, big.join(small, "token", how).select("i", "token", "w").collect()), key=str)
    joined = checked_lookup_join(big, small, "token", 8, max_rows=bound, how=how)
    assert sorted(map(tuple, joined.select("i", "token", "w").collect()), key=str) == want


def test_hot_keys_come_from_the_large_side_and_stay_out_of_the_shuffle(spark, no_auto_broadcast):
    from moodline.operators.joins import hot_keys
    big = spark.createDataFrame([(i, "unseen" if i % 3 == 0 else f"t{i}") for i in range(900)], "i int, token string")
    assert [r[0] for r in hot_keys(big, "token", share=100).collect()] == ["unseen"]
    small = materialize(spark.createDataFrame([(f"t{k}", k) for k in range(0, 900, 7)], "token string, w int"))
    joined = checked_lookup_join(big, small, "token", 129, max_rows=5, how="left").filter(
        "token is not null and token <> 'unseen'")
    assert joined.count() == 600
    cold = spark.createDataFrame([(r["token"],) for r in big.collect() if r["token"] != "unseen"], "token string")
    sizes = cold.repartition(4, "token").rdd.glom().map(len).collect()
    assert max(sizes) < 300  # the hot key's 300 rows would have made the largest partition


def test_a_heavy_lookup_side_is_not_broadcast(spark):
    from moodline.operators.joins import BROADCAST_BYTES_CONF, fits_broadcast
    small = spark.createDataFrame([("x" * 1000, 1), ("y" * 1000, 2)], "token string, w int")
    assert fits_broadcast(small, "token", 2)
    spark.conf.set(BROADCAST_BYTES_CONF, "1500")
    try:
        assert not fits_broadcast(small, "token", 2)
    finally:
        spark.conf.unset(BROADCAST_BYTES_CONF)


def test_model_store_round_trip_and_versions(model, spark, tmp_path, test_df):
    store = ModelStore(spark, str(tmp_path / "models"))
    assert store.versions("m") == [] and store.latest().count() == 0
    assert store.register("m", model) == 1
    assert store.register("m", model) == 2
    r = store.latest().first()
    assert (r["name"], r["latest_version"], r["n_versions"], r["vocab_size"]) == ("m", 2, 2, model.vocab_size)
    names = spark.createDataFrame([("m",), ("other",)], "name string")
    assert [x["name"] for x in store.exists(names).collect()] == ["m"]
    again = ModelStore(spark, str(tmp_path / "models")).load("m")
    assert again.priors == model.priors and again.vocab_size == model.vocab_size
    score = lambda m: sorted(map(tuple, K.probabilities(m, test_df).collect()))
    assert score(again) == score(model)
    with pytest.raises(LookupError):
        store.load("m", 7)


def test_model_store_never_overwrites(model, spark, tmp_path):
    import os
    store = ModelStore(spark, str(tmp_path / "models"))
    assert store.register("m", model) == 1
    os.makedirs(tmp_path / "models" / "m" / "version=2")  # another writer, not finished
    (tmp_path / "models" / "m" / "version=2" / "_claim").touch()
    assert store.versions("m") == [1]
    assert store.register("m", model) == 3
    assert store.versions("m") == [1, 3]


def test_store_of_the_session_is_at_a_fixed_place(spark):
    assert ModelStore.for_session(spark).root == ModelStore.for_session(spark).root


def test_classifier_defaults_keep_colliding_words_apart(spark):
    """Two words that share a bucket of 2^16 have weights of their own."""
    from pyspark.ml.feature import HashingTF

    from moodline.operators.classifier import choose_and_predict
    small, seen, pair = HashingTF(numFeatures=1 << 16), {}, None
    large = HashingTF(numFeatures=1 << 18)
    for i in range(3000):
        word = "w" + "".join(chr(97 + i // 26 ** k % 26) for k in range(3))
        other = seen.setdefault(small.indexOf(word), word)
        if other != word and large.indexOf(other) != large.indexOf(word):
            pair = other, word
            break
    assert pair
    train = spark.createDataFrame([(i, pair[i % 2] if i % 3 else "neutral", 2 * (i % 2) if i % 3 else 1)
                                   for i in range(240)], "doc_id long, text string, label int")
    test = spark.createDataFrame([(1, pair[0], 0), (2, pair[1], 2)], "doc_id long, text string, label int")
    got = {r.doc_id: r.predicted_code for r in choose_and_predict(train, test)[0].collect()}
    assert got == {1: 0, 2: 2}


def test_a_step_of_the_classifier_sends_one_gradient_a_core(spark, monkeypatch):
    import threading

    from moodline.operators import classifier
    seen, together = [], threading.Barrier(3, timeout=60)
    real = classifier.LogisticRegression.fit

    def fit(self, rows):
        together.wait()  # the candidates are fitted side by side
        seen.append(rows.rdd.getNumPartitions())
        return real(self, rows)

    monkeypatch.setattr(classifier.LogisticRegression, "fit", fit)
    train = spark.createDataFrame([(i, f"word{i % 3}", i % 3) for i in range(90)], "doc_id long, text string, label int")
    classifier.choose_and_predict(train.repartition(40), train, num_features=64, max_iter=3)
    assert seen == [spark.sparkContext.defaultParallelism] * 3
