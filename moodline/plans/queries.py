"""The named batch queries. Each takes (spark, sf_dir) and returns a DataFrame
whose column names equal those of the matching SQL in ``plans.oracle``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moodline.functions import labels as L
from moodline.functions import scoring as S
from moodline.functions import text as T
from moodline.operators import encoding as E
from moodline.operators import reports as R
from moodline.operators import scorer as K
from moodline.operators.classifier import MAX_ITER, NUM_FEATURES
from moodline.operators.sampling import class_quotas, first_n
from moodline.plans.common import (TEST_FRACTION, labelled_posts, split_table, test_posts,
                                   train_model, train_posts)
from moodline.session import scratch_path
from moodline.sources import columns, csv_io, model_store
from moodline.sources.tables import (clean_columns, doc_labels, documents_clean, label_rows, posts,
                                     read_keyed, read_table)

P = ["p_negative", "p_neutral", "p_positive"]


# ---------------------------------------------------------------- cleaning
def clean_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_keyed(spark, sf_dir, "documents", "doc_id", "doc_id", "text")
    return d.select("doc_id", F.col("text").alias("original_text"),
                    T.remove_mentions(F.col("text")).alias("text"),
                    T.has_mention(F.col("text")).alias("has_mention"))


def mention_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    return R.mention_stats(d, "text")


def clean_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the first 5 are taken on the raw rows (a range cut on the key, no
    # merge of 5 rows from every task); only those 5 are cleaned
    d = first_n(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", 5)
    return d.select("doc_id", F.col("text").alias("original_text"),
                    T.remove_mentions(F.col("text")).alias("cleaned_text"))


def first_n_posts(spark: SparkSession, sf_dir: str, n: int = 300) -> DataFrame:
    # the first n are taken on the raw rows (a range cut on the key, no merge
    # of n rows from every task); only those n are cleaned
    raw = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return clean_columns(first_n(raw, "doc_id", n)).select("doc_id", "platform", "text")


def clean_stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.stage_counts(posts(spark, sf_dir))


# ---------------------------------------------------------------- labels
def label_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = posts(spark, sf_dir).filter(F.col("has_text") & F.col("raw_label").isNotNull())
    return p.select(T.py_strip(F.col("raw_label")).alias("label_value")).distinct()


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_posts(spark, sf_dir).select("doc_id", "text", "label")


def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    lp = labelled_posts(spark, sf_dir)
    return (lp.groupBy("label").agg(F.count(F.lit(1)).alias("n_posts"))
            .select("label", L.code_to_label(F.col("label")).alias("sentiment"), "n_posts")
            .orderBy(F.desc("n_posts"), "label"))


def label_capitalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = posts(spark, sf_dir).filter(F.col("raw_label").isNotNull())
    return p.select("doc_id", "raw_label",
                    T.capitalize(F.col("raw_label")).alias("capitalized_raw"),
                    T.capitalize(T.py_strip(F.col("raw_label"))).alias("label_std"))


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_table(spark, sf_dir).select("doc_id", "label", "split")


def split_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = split_table(spark, sf_dir)
    # the written split holds every labelled post once: the quotas are
    # recomputed from it without another pass over the text
    q = class_quotas(s.select("label"), "label", TEST_FRACTION)
    got = s.groupBy("label").agg(F.count(F.lit(1)).alias("n_class"),
                                 F.count_if(F.col("split") == "test").alias("n_test"),
                                 F.count_if(F.col("split") == "train").alias("n_train"))
    return got.join(F.broadcast(q.select("label", "quota")), "label")


# ---------------------------------------------------------------- model
def nb_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, _ = train_model(spark, sf_dir)
    return model.weights.select("token", "n0", "n1", "n2", "n_occ", "wq0", "wq1", "wq2")


def _scored(spark, sf_dir, keyed=False):
    model, split = train_model(spark, sf_dir)
    docs = documents_clean(spark, sf_dir, keyed).select("doc_id", "text", "has_text", "platform")
    return model, split, docs, K.probabilities(model, K.gate_nonempty(docs), "doc_id", "text")


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, _, pr = _scored(spark, sf_dir)
    return pr.select("doc_id", *P)


def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, _, pr = _scored(spark, sf_dir)
    n, u, p = (F.col(c) for c in P)
    a, b = S.top_two(n, u, p)
    return pr.select("doc_id", a.alias("top_prob"), b.alias("second_prob"),
                     S.confidence(n, u, p).alias("confidence"))


def sentiment_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, _, pr = _scored(spark, sf_dir)
    n, u, p = (F.col(c) for c in P)
    return (pr.select("doc_id", S.sentiment_rule_a(n, u, p).alias("rule_a"),
                      S.sentiment_rule_b(n, u, p).alias("rule_b"))
            .withColumn("rules_differ", F.col("rule_a") != F.col("rule_b")))


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, _, pr = _scored(spark, sf_dir)
    return pr.select("doc_id", F.col("p_negative").alias("toxicity_score"),
                     S.toxicity_level(F.col("p_negative")).alias("toxicity_level"),
                     (F.col("p_negative") * 100).alias("gauge_value"))


def raw_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, _, pr = _scored(spark, sf_dir)
    m = S.raw_scores_map(*(F.col(c) for c in P))
    return pr.select("doc_id", m.alias("raw")).select(
        "doc_id", F.col("raw")["Negative"].alias("negative_pct"),
        F.col("raw")["Neutral"].alias("neutral_pct"), F.col("raw")["Positive"].alias("positive_pct"))


def app_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interactive result record for every scorable post."""
    _, _, _, pr = _scored(spark, sf_dir)
    rec = K.with_advice(K.app_fields(pr))
    r = rec.select("doc_id", K.result_struct(rec).alias("r")).select("doc_id", "r.*")
    return r.select("doc_id", "sentiment", "toxicity_score", "toxicity_level", "confidence",
                    "suggestions",
                    *[F.col("probabilities")[i].alias(c) for i, c in enumerate(P)],
                    F.col("raw_scores")["Negative"].alias("negative_pct"),
                    F.col("raw_scores")["Neutral"].alias("neutral_pct"),
                    F.col("raw_scores")["Positive"].alias("positive_pct"))


def flagged_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, _, docs, _ = _scored(spark, sf_dir)
    # the platform rides along in the scorer's group-by: no join back to posts
    pr = K.probabilities(model, K.gate_nonempty(docs), ["doc_id", "platform"], "text")
    flagged = K.app_fields(pr).filter(F.col("toxicity_level") != "Low")
    return K.with_advice(flagged).select("doc_id", "platform", "toxicity_level", "toxicity_score",
                                         "suggestions")


def scored_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored table of the batch evaluation (S4), every post kept, with
    its text."""
    # scored where it is read, the text stays on its row; beyond the broadcast
    # bounds it is a group key of the scorer's one shuffle
    model, _, docs, _ = _scored(spark, sf_dir)
    scored = R.scored_table(model, docs.select("doc_id", "text", "platform"), doc_labels(spark, sf_dir),
                            label_rows(spark, sf_dir), carry=("text",))
    return scored.select("doc_id", "platform", "text", "label", "predicted", "confidence", "matches_original")


def score_with_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, _, docs, _ = _scored(spark, sf_dir)
    r = K.score_with_errors(model, docs.select("doc_id", "text"))
    return r.select("doc_id", F.col("sentiment").alias("predicted"), "confidence",
                    *[F.col("probabilities")[i].alias(c) for i, c in enumerate(P)])


def score_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, _, docs, _ = _scored(spark, sf_dir)
    return K.score_distinct(model, K.gate_nonempty(docs), "doc_id", "text").select("doc_id", *P)


def score_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3 across runs: the table as it was (posts with an even id) is scored
    and kept, then the grown table. All posts, and whether the score was there."""
    from moodline.operators.score_store import ScoreStore
    model, _, docs, _ = _scored(spark, sf_dir)
    store = ScoreStore(spark, model_store.MODEL_NAME, 1, scratch_path(spark, "scores"))
    store.score(model, docs.filter(F.col("doc_id") % 2 == 0))
    return store.score(model, docs).rows.select("doc_id", *P, "reused")


def score_batch_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, _, docs, _ = _scored(spark, sf_dir)
    return K.probabilities(model, K.gate_nonempty(docs), "doc_id", "text", in_place=True).select("doc_id", *P)


def evaluate_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch evaluation from a CSV with unknown column names: posts are
    written as CSV (S2) under reference-style names, read back as strings
    (S1), their columns discovered and renamed (P1, P2), scored, and the
    scored table written partitioned by platform (S4) and read back."""
    model, _ = train_model(spark, sf_dir)
    raw = posts(spark, sf_dir).select(F.col("doc_id").alias("post_id"), F.col("text").alias("tweet_text"),
                      F.col("raw_label").alias("airline_sentiment"),
                      F.col("platform").alias("Platform_Name"))
    path = scratch_path(spark, "evaluate")
    csv_io.write_posts_csv(raw, f"{path}/posts_csv")
    std = columns.standardize(csv_io.read_posts_csv(spark, f"{path}/posts_csv"), keep=["post_id"])
    back = std.select(F.col("post_id").cast("long").alias("doc_id"), F.col("Text").alias("text"),
                      *([F.col("Platform").alias("platform")] if "Platform" in std.columns else []),
                      F.col("Sentiment").alias("raw_label"))
    return R.write_scored(R.scored_table(model, back), f"{path}/scored")


# ---------------------------------------------------------------- reports
def platform_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, _, docs, _ = _scored(spark, sf_dir)
    return R.platform_stats(_scored_table(spark, sf_dir, model, docs))


def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, split = train_model(spark, sf_dir)
    return R.accuracy(_scored_table(spark, sf_dir, model, test_posts(spark, sf_dir, split)))


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, split = train_model(spark, sf_dir)
    return R.confusion_matrix(_scored_table(spark, sf_dir, model, test_posts(spark, sf_dir, split)))


def _scored_table(spark, sf_dir, model, docs):
    # labels are joined to the one-row-per-post scores, not to the text
    return R.scored_table(model, docs.select("doc_id", "text", "platform"),
                          doc_labels(spark, sf_dir), label_rows(spark, sf_dir))


def toxicity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, _, pr = _scored(spark, sf_dir)
    return R.toxicity_histogram(pr)


def batch_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, split = train_model(spark, sf_dir)
    return R.batch_loss(model, test_posts(spark, sf_dir, split), n_train=sum(model.class_docs))


def best_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from moodline.operators.model_selection import select_alpha
    model, split = train_model(spark, sf_dir)
    train = train_posts(spark, sf_dir, split)
    # every candidate starts from the token counts of the trained model
    return select_alpha(train, test_posts(spark, sf_dir, split), counts=model.counts,
                        class_docs=dict(enumerate(model.class_docs)))


def model_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from moodline.operators.model_selection import CANDIDATE_ALPHAS
    from moodline.operators import naive_bayes as nb
    trained, split = train_model(spark, sf_dir)
    train = train_posts(spark, sf_dir, split)
    counts = trained.counts
    store = model_store.ModelStore(spark, scratch_path(spark, "models"))
    docs = dict(enumerate(trained.class_docs))
    for alpha in CANDIDATE_ALPHAS:
        m = nb.fit(train, alpha=alpha, counts=counts, class_docs=docs)
        store.register(model_store.MODEL_NAME, m)
    return store.latest().select("name", "latest_version", "n_versions", "vocab_size", "alpha")


def score_with_stored_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register the trained model, load it by name in another store object and
    score with it: equal to ``probabilities``."""
    trained, _ = train_model(spark, sf_dir)
    root = scratch_path(spark, "models")
    model_store.ModelStore(spark, root).register(model_store.MODEL_NAME, trained)
    model = model_store.ModelStore(spark, root).load(model_store.MODEL_NAME)
    docs = documents_clean(spark, sf_dir).select("doc_id", "text", "has_text")
    return K.probabilities(model, K.gate_nonempty(docs), "doc_id", "text").select("doc_id", *P)


# ---------------------------------------------------------------- encoding
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.vocabulary(documents_clean(spark, sf_dir).filter(F.col("has_text")), "text")


def encode_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = documents_clean(spark, sf_dir).filter(F.col("has_text")).select("doc_id", "text")
    vocab = E.vocabulary(p, "text")
    enc = E.encode(p, vocab, "doc_id", "text")
    return enc.select("doc_id", "chunk", "n_tokens",
                      F.array_join(F.col("input_ids"), " ").alias("ids_text"),
                      F.aggregate(F.col("attention_mask"), F.lit(0), lambda a, x: a + x).alias("mask_ones"))


def epoch_batches(spark: SparkSession, sf_dir: str, epochs: int = 3) -> DataFrame:
    """Three epochs over the train part, each in an order of its own,
    cut into batches of 32."""
    from moodline.operators.sampling import with_epoch_batches
    train = split_table(spark, sf_dir).filter(F.col("split") == "train").select("doc_id", "label")
    return with_epoch_batches(train, "doc_id", epochs).select("epoch", "doc_id", "label", "place", "batch_id")


def encode_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 with the pieces of a public vocabulary file: no unknown words."""
    import public_tokenizers

    from moodline.operators.subwords import encode_subwords as encode
    p = documents_clean(spark, sf_dir).filter(F.col("has_text")).select("doc_id", "text")
    enc = encode(p, public_tokenizers.path("word_bpe_49k.json"))
    return enc.select("doc_id", "chunk", "n_tokens",
                      F.array_join(F.col("input_ids"), " ").alias("ids_text"),
                      F.aggregate(F.col("attention_mask"), F.lit(0), lambda a, x: a + x).alias("mask_ones"))


# ---------------------------------------------------------------- sources / sinks
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_keyed(spark, sf_dir, "documents", "doc_id", "doc_id", "text", "lang", "source")
    back = csv_io.roundtrip(d)
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")


# ---------------------------------------------------------------- history
def _history(spark, sf_dir):
    model, _ = train_model(spark, sf_dir)
    conv = read_keyed(spark, sf_dir, "conversations", ["conv_id", "turn"])
    return R.history_rows(model, conv)


def history_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir)


def history_last_n(spark: SparkSession, sf_dir: str, n: int = 5) -> DataFrame:
    h = _history(spark, sf_dir)
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return h.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


# ---------------------------------------------------------------- classifier
def logreg_predictions(spark: SparkSession, sf_dir: str, num_features: int = NUM_FEATURES,
                       max_iter: int = MAX_ITER) -> DataFrame:
    from moodline.operators.classifier import choose_and_predict
    return choose_and_predict(*_classifier_parts(spark, sf_dir), num_features=num_features, max_iter=max_iter)[0]


def logreg_selection(spark: SparkSession, sf_dir: str, num_features: int = NUM_FEATURES,
                     max_iter: int = MAX_ITER) -> DataFrame:
    """What is certain about the fitted classifier: a row for each post of the
    test part with its label, probabilities that add up to 1, a prediction
    that is their largest, and a chosen candidate that is the first with the
    best validation accuracy."""
    from moodline.operators.classifier import choose_and_predict
    out, accuracy, chosen = choose_and_predict(*_classifier_parts(spark, sf_dir), num_features=num_features,
                                              max_iter=max_iter)
    n, u, p = (F.col(c) for c in P)
    return out.select("doc_id", "label", F.round(n + u + p, 6).alias("p_sum"),
                      (F.col("predicted_code") == S.argmax3(n, u, p)).alias("is_largest"),
                      F.lit(len(accuracy)).alias("n_candidates"),
                      F.lit(chosen == accuracy.index(max(accuracy))).alias("is_first_best"))


def epoch_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss and accuracy of each training epoch, and the best one."""
    from moodline.operators import epoch_training as T3
    trained = T3.train(*_classifier_parts(spark, sf_dir))
    table = T3.metrics_table(spark, trained)
    return table.select("epoch", "n_steps", *[F.round(c, 6).alias(c) for c in (
        "train_loss", "train_accuracy", "val_loss", "val_accuracy")], "is_best")


def epoch_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test part, predicted by the best epoch's weights."""
    from moodline.operators import epoch_training as T3
    train, test = _classifier_parts(spark, sf_dir)
    return T3.predict(test, T3.train(train, test))


def _classifier_parts(spark, sf_dir):
    _, split = train_model(spark, sf_dir)
    return (train_posts(spark, sf_dir, split),
            test_posts(spark, sf_dir, split).select("doc_id", "text", "label"))
