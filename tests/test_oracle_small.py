"""Every registered query against its DuckDB SQL on the sf0.001 tables
(the full sf0.01 check is ``python tests/oracle_check.py``)."""

import os

import pytest

from conftest import SMALL

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables not present")

import __spark_entry__ as E  # noqa: E402
from oracle_check import compare, duck  # noqa: E402

FAST = ["clean_mentions", "mention_stats", "label_values", "stratified_split", "split_balance",
        "nb_weights", "probabilities", "score_with_errors", "platform_stats", "confusion_matrix",
        "batch_loss", "best_model", "encode_posts", "history_last_n", "toxicity_by_hour",
        "user_sessions", "first_n_posts", "clean_sample", "vocabulary", "labelled", "accuracy",
        "history_last_n_stream", "stream_scored", "dedupe_per_minute", "stream_score_text",
        "score_with_stored_model", "scored_posts", "score_batch_udf"]


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_every_query_is_registered_with_sql_or_rows_only():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert set(E._BATCH + E._STREAM) - set(sql) == {"logreg_predictions", "encode_subwords", "epoch_training", "epoch_predictions"}


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, con, name):
    ok, msg = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SMALL)
    assert ok, msg


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns[0] == "platform" and df.count() >= 0


BEYOND_BOUND = ["probabilities", "score_distinct", "platform_stats", "accuracy", "scored_posts",
                "stream_scored", "clean_stage_counts", "encode_posts", "score_batch_udf", "dedupe_per_minute"]


@pytest.mark.parametrize("name", BEYOND_BOUND)
def test_query_matches_sql_when_lookup_sides_exceed_the_broadcast_bound(spark, con, name):
    # labels, weights, split parts and the stream-static side all count more
    # than 20 rows, and Spark may not broadcast by itself: shuffle joins and
    # the hot/cold split run, with the same result
    from moodline.operators.joins import BROADCAST_ROWS_CONF
    auto = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(auto)
    spark.conf.set(BROADCAST_ROWS_CONF, "20")
    spark.conf.set(auto, "-1")
    try:
        ok, msg = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SMALL)
    finally:
        spark.conf.unset(BROADCAST_ROWS_CONF)
        spark.conf.set(auto, before)
    assert ok, msg
