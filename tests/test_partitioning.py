"""Where text is shuffled: a table is spread by key only when its scan has
fewer splits than the cluster has cores; scoring reports join labels to the
narrow per-post scores."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from conftest import SMALL
from moodline.sources.tables import documents_clean, posts, spread


def _plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_spread_keeps_a_finely_split_input(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    wide = spark.range(0, 1000, 1, numPartitions=cores * 2)
    assert "Exchange" not in _plan(spread(wide, "id"))
    assert spread(wide, "id").rdd.getNumPartitions() == cores * 2


def test_spread_partitions_a_single_split_by_key(spark):
    narrow = spark.range(0, 1000, 1, numPartitions=1)
    out = spread(narrow, "id")
    assert "hashpartitioning(id" in _plan(out)
    assert out.count() == 1000


def test_documents_clean_has_no_label_join(spark):
    plan = _plan(documents_clean(spark, SMALL))
    assert "Join" not in plan
    assert "labels.parquet" not in plan


def test_label_join_of_posts_is_a_counted_broadcast_and_prunes_text(spark):
    # the flags-only projection of posts carries no text through the join
    flags = posts(spark, SMALL).select("doc_id", "has_text", "raw_label")
    plan = _plan(flags)
    assert "BroadcastHashJoin" in plan
    join_line = next(line for line in plan.splitlines() if "BroadcastHashJoin" in line)
    assert "text" not in join_line.split("BroadcastHashJoin", 1)[1].split("]")[0]
    full = posts(spark, SMALL)
    assert full.count() == documents_clean(spark, SMALL).count()
    assert full.filter(F.col("raw_label").isNotNull()).count() > 0


TEXT_FREE = ["probabilities", "app_records", "platform_stats", "accuracy", "confusion_matrix",
             "toxicity_histogram", "score_with_errors", "score_distinct", "flagged_posts",
             "batch_loss", "best_model", "vocabulary", "clean_stage_counts", "labelled",
             "first_n_posts", "history_last_n", "scored_posts", "score_batch_udf", "encode_posts"]


def _text_exchanges(df) -> list[str]:
    import re
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    inputs = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", buf.getvalue())
    return [i for i in inputs if re.search(r"\b(text|original_text)#", i)]


def test_no_exchange_carries_text_when_the_scan_is_split(spark, monkeypatch):
    # a cluster reads the documents in many splits: the reader then leaves
    # them in place, and no scoring or report query may shuffle text; plans
    # that are written on the way (training, distinct texts) are looked at too
    import __spark_entry__ as E
    from moodline.operators import encoding, joins, model_selection, naive_bayes, scorer
    from moodline.plans import common
    from moodline.sources import tables
    monkeypatch.setattr(tables, "spread", lambda df, key: df)
    seen = []

    def watched(df):
        seen.extend(_text_exchanges(df))
        return joins_materialize(df)

    joins_materialize = joins.materialize
    for module in (encoding, joins, model_selection, naive_bayes, scorer, common):
        monkeypatch.setattr(module, "materialize", watched)
    common._SPLITS.clear()
    common._MODELS.clear()
    qs = E.queries()
    for name in TEXT_FREE:
        assert _text_exchanges(qs[name](spark, SMALL)) == [], name
        assert seen == [], name
