"""S1-S3 CSV round trip, E1/E2/U2 encoding, R4b last-n state function."""

import pandas as pd
from pyspark.sql import functions as F

from moodline.operators import encoding as E
from moodline.sources import csv_io
from moodline.streaming.jobs import HISTORY_COLS, _last_n_state

AWKWARD = ["  padded  ", 'say "hi"', "line\nbreak", "crlf\r\nend", "back\\", "a,b", "NA", "", None,
           "trailing \\\"", "😀 emoji"]


def test_csv_roundtrip_keeps_text(spark):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(AWKWARD)], "id string, text string")
    back = {r["id"]: r["text"] for r in csv_io.roundtrip(df).collect()}
    for i, t in enumerate(AWKWARD):
        want = None if t in ("", "NA", None) else t   # pandas' missing markers
        assert back[str(i)] == want, (t, back[str(i)])


def test_vocabulary_and_encoding(spark):
    docs = spark.createDataFrame([(1, "b a b c"), (2, "a b"), (3, " ".join(["w"] * 130))],
                                 "doc_id long, text string")
    vocab = E.vocabulary(docs, "text", size=3)
    v = {r["token"]: r["token_id"] for r in vocab.collect()}
    assert v["w"] == 4 and v["b"] == 5 and v["a"] == 6     # count desc; "c" cut by size
    enc = {(r["doc_id"], r["chunk"]): r for r in E.encode(docs, vocab).collect()}
    one = enc[(1, 0)]
    assert one["input_ids"][:6] == [1, 5, 6, 5, E.UNKNOWN_ID, 2]
    assert len(one["input_ids"]) == 128 and one["input_ids"][6:] == [0] * 122
    assert one["attention_mask"] == [1] * 6 + [0] * 122
    # a long text is encoded whole, in chunks of 126 tokens
    assert sorted(k for k in enc if k[0] == 3) == [(3, 0), (3, 1)]
    assert enc[(3, 1)]["attention_mask"].count(1) == 4 + 2
    assert enc[(3, 0)]["n_tokens"] == 130


class _State:
    def __init__(self):
        self.value = None

    @property
    def exists(self):
        return self.value is not None

    @property
    def get(self):
        return self.value

    def update(self, v):
        self.value = v


def test_last_n_state_keeps_latest_turns():
    fn = _last_n_state(3)
    st = _State()

    def chunk(turns):
        return pd.DataFrame({"conv_id": [7] * len(turns), "turn": turns, "role": "user",
                             "preview": [f"p{t}" for t in turns], "sentiment": "Neutral",
                             "toxicity_level": "Low", "confidence_text": "50.0%"})
    out1 = pd.concat(list(fn((7,), iter([chunk([1, 2])]), st)))
    assert sorted(out1["turn"]) == [1, 2]
    out2 = pd.concat(list(fn((7,), iter([chunk([5, 3]), chunk([4])]), st)))
    assert sorted(out2["turn"]) == [3, 4, 5]
    assert list(out2.columns) == HISTORY_COLS
    # salted key (session, salt): the salt is part of the output
    salted = pd.concat(list(fn((7, 2), iter([chunk([9])]), _State())))
    assert list(salted.columns) == HISTORY_COLS + ["_salt"] and list(salted["_salt"]) == [2]


def test_column_discovery(spark):
    import pytest

    from moodline.sources import columns as C
    df = spark.createDataFrame([("1", "hi", "pos", "x", "web")],
                               "id string, Tweet_Text string, Airline_Sentiment string, "
                               "Sentiment_Score string, platform_name string")
    out = C.standardize(df, keep=["id"])
    assert out.columns == ["id", "Text", "Sentiment", "Platform"]
    assert tuple(out.first()) == ("1", "hi", "pos", "web")   # first match in column order
    no_platform = C.standardize(df.drop("platform_name"))
    assert no_platform.columns == ["Text", "Sentiment"]
    both = spark.createDataFrame([("a",)], "text_sentiment string")
    assert C.standardize(both).columns == ["Text", "Sentiment"]   # one column, two names
    with pytest.raises(ValueError):
        C.standardize(df.drop("Tweet_Text"))


def test_vocabulary_ranks_equal_a_plain_sort(spark):
    import hashlib
    words = ["zeta zeta zeta alpha alpha", "beta gamma delta épée eta theta iota kappa lambda",
             "mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega aaaaaaaab aaaaaaaaa aaaaaaaa"]
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    toks = [t for w in words for t in w.split()]
    counts = {t: toks.count(t) for t in set(toks)}
    order = sorted(counts, key=lambda t: (-counts[t], hashlib.md5(t.encode()).hexdigest()))
    for size in (None, 1, 3, 30):
        got = [(r["token"], r["token_id"], r["n_occ"]) for r in
               E.vocabulary(docs, "text", size=size).orderBy("token_id").collect()]
        assert got == [(t, i + E.FIRST_WORD_ID, counts[t]) for i, t in enumerate(order[:size])], size


def test_written_platforms_come_back_as_they_were(spark, tmp_path):
    from moodline.operators.reports import write_scored
    df = spark.createDataFrame([(1, ""), (2, None), (3, "007"), (4, "a/b=c"), (5, "none")], "doc_id long, platform string")
    back = write_scored(df, str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == [(1, ""), (2, None), (3, "007"), (4, "a/b=c"), (5, "none")]


def test_stream_job_goes_on_where_it_stopped(spark, tmp_path):
    import uuid

    from moodline.operators import naive_bayes as nb
    from moodline.operators import scorer as K
    from moodline.operators.joins import materialize
    from moodline.streaming import jobs as J
    model = nb.fit(spark.createDataFrame([(1, "good fine", 2), (2, "bad hate", 0), (3, "ok", 1)],
                                         "doc_id long, text string, label int"))
    model.weights = materialize(model.weights)
    schema = "conv_id long, turn long, text string"
    rows = [(1, t, x) for t, x in enumerate(["good", "hate it", None, "", "unknown", "ok fine bad"])]
    name = f"test-{uuid.uuid4().hex}"

    def arrive(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        return J.score_text_stream(stream, model, name)

    arrive(rows[:2])
    assert run().count() == 2
    log = J.shared_path(spark, f"streams/{name}") + "/log"
    first = J.read_log(spark, log, J.TEXT_SCORES).select("v").distinct().count()
    arrive(rows[2:4])
    arrive(rows[4:])
    out = run()
    assert J.read_log(spark, log, J.TEXT_SCORES).select("v").distinct().count() == first + 2
    batch = {r["doc_id"]: r["p_negative"] for r in K.probabilities(
        model, spark.createDataFrame([(t, x) for _, t, x in rows], "doc_id long, text string")).collect()}
    got = {r["turn"]: r for r in out.collect()}
    assert len(got) == 6
    for t in range(6):
        assert got[t]["p_negative"] == batch.get(t)
        assert (got[t]["sentiment"] == "Error") == (t not in batch)


def test_missing_log_is_empty_and_other_errors_come_out(spark, tmp_path):
    import pytest

    from moodline.streaming import jobs as J
    assert J.latest_per_session(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "log" / "v=0").mkdir(parents=True)
    (tmp_path / "log" / "v=0" / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):
        J.latest_per_session(spark, str(tmp_path / "log")).count()
