"""Counts and evaluation reports.

Every report is one aggregation (partial aggregates map-side, one shuffle of
at most one row per group and task); none collects rows of a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodline.functions import labels as L
from moodline.functions import scoring as S
from moodline.functions import text as T
from moodline.operators import naive_bayes as nb
from moodline.operators import scorer as K
from moodline.operators.joins import checked_lookup_join
from moodline.operators.sampling import BATCH_SIZE, with_batches

# Confusion matrix columns (the three classes, then failures).
PREDICTED_VALUES = ["Negative", "Neutral", "Positive", "Error"]
EPOCHS = 3
REPORT_DECIMALS = 3


def mention_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Total rows, rows holding any '@', share in percent (null if empty)."""
    return docs.agg(F.count(F.lit(1)).alias("total_rows"),
                    F.count_if(T.has_mention(F.col(text))).alias("rows_with_mentions")
                    ).select("total_rows", "rows_with_mentions",
                             (F.try_divide(F.col("rows_with_mentions"), F.col("total_rows")) * 100)
                             .alias("pct_with_mentions"))


def stage_counts(posts: DataFrame) -> DataFrame:
    """Row count at each clean-up stage, one pass (A1)."""
    has_text = F.col("has_text") if "has_text" in posts.columns else F.col("text").isNotNull()
    complete = has_text & F.col("raw_label").isNotNull()
    known = complete & L.label_to_code(F.col("raw_label")).isNotNull()
    return posts.agg(F.count(F.lit(1)).alias("n_input"),
                     F.count_if(complete).alias("n_complete"),
                     F.count_if(known).alias("n_known_label"))


def scored_table(model: nb.NBModel, docs: DataFrame, labels: DataFrame | None = None,
                 label_rows: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """The scored posts of the batch evaluation.

    Input: doc_id, text, platform, and raw_label either as a column of
    ``docs`` (a posts CSV) or as the narrow table ``labels`` (doc_id,
    raw_label; ``label_rows`` rows), which is joined to the one-row-per-post
    scores, not to the text. Every row is kept; rows that cannot be scored
    get 'Error' and confidence 0.0. The label is stripped before it is
    capitalised, and a missing label never matches. ``carry`` columns (the text, say) stay on
    their row: such a table is scored in place if the model is within the
    broadcast bounds. Without a platform column
    the platform is null, and ``platform_stats`` has no row.
    """
    std_label = lambda c: T.capitalize(T.py_strip(c))
    inline = labels is None
    platform = F.col("platform") if "platform" in docs.columns else F.lit(None).cast("string")
    base = docs.select("doc_id", T.py_strip(platform).alias("platform"), "text", *[c for c in carry if c != "text"],
                       *([std_label(F.col("raw_label")).alias("label")] if inline else []))
    keys = ["doc_id", "platform", *carry] + (["label"] if inline else [])
    scored = K.batch_fields(K.probabilities(model, base, keys, "text", outer=True, in_place=bool(carry)))
    if not inline:
        lab = labels.select("doc_id", std_label(F.col("raw_label")).alias("label"))
        n_lab = label_rows if label_rows is not None else lab.count()
        scored = checked_lookup_join(scored, lab, "doc_id", n_lab, how="left")
    ok = F.col("n_known") > 0
    predicted = F.when(ok, F.col("predicted")).otherwise(F.lit("Error"))
    return scored.select(
        "doc_id", "platform", *carry, "label", predicted.alias("predicted"),
        F.when(ok, F.col("confidence")).otherwise(F.lit(0.0)).alias("confidence"),
        F.coalesce(F.col("label") == predicted, F.lit(False)).alias("matches_original"))


def write_scored(scored: DataFrame, path: str, files_per_platform: int = 8) -> DataFrame:
    """Write the scored table as Parquet partitioned by platform (S4) and
    return it read back with its own columns. Partition folders are named by
    an escaped value, so an empty platform, a missing one and one that looks
    like a number come back as they were. Narrow rows are dealt by (platform,
    salt) first: a platform has at most ``files_per_platform`` files, and one
    with a third of all rows is not one task."""
    folder = F.when(F.col("platform").isNull(), F.lit("none")).otherwise(F.concat(F.lit("is:"), "platform"))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(files_per_platform))
    out = scored.withColumn("platform_folder", folder).withColumn("_salt", salt)
    (out.repartition("platform_folder", "_salt").drop("_salt")
     .write.mode("overwrite").partitionBy("platform_folder").parquet(path))
    return scored.sparkSession.read.schema(scored.schema).parquet(path).select(*scored.columns)


def platform_stats(scored: DataFrame) -> DataFrame:
    """Per platform: labelled count, mean and sample std of confidence, mean
    match (all rows and labelled rows), rounded half-even to 3 places."""
    m = F.col("matches_original").cast("int")
    r = lambda c: F.bround(c, REPORT_DECIMALS)
    return (scored.filter(F.col("platform").isNotNull())
            .groupBy("platform")
            .agg(F.count(F.lit(1)).alias("n_rows"),
                 F.count("label").alias("n_labelled"),
                 r(F.avg("confidence")).alias("avg_confidence"),
                 r(F.stddev_samp("confidence")).alias("std_confidence"),
                 r(F.avg(m)).alias("accuracy"),
                 r(F.avg(F.when(F.col("label").isNotNull(), m))).alias("labelled_accuracy")))


def accuracy(scored: DataFrame) -> DataFrame:
    """Overall accuracy in percent; failed and unlabelled rows count in the
    total (A5)."""
    return scored.agg(F.count(F.lit(1)).alias("n_total"),
                      F.count_if(F.col("matches_original")).alias("n_match")).select(
        "n_total", "n_match",
        (F.try_divide(F.col("n_match"), F.col("n_total")) * 100).alias("accuracy_pct"))


def confusion_matrix(scored: DataFrame) -> DataFrame:
    """label x predicted, each row normalised to shares, rounded to 3 places,
    times 100; fixed, zero-filled columns (A7)."""
    both = scored.filter(F.col("label").isNotNull() & F.col("predicted").isNotNull())
    wide = both.groupBy("label").pivot("predicted", PREDICTED_VALUES).agg(F.count(F.lit(1)))
    filled = wide.select("label", *[F.coalesce(F.col(v), F.lit(0)).alias(v) for v in PREDICTED_VALUES])
    total = sum((F.col(v) for v in PREDICTED_VALUES[1:]), F.col(PREDICTED_VALUES[0]))
    return filled.select("label", *[(F.bround(F.col(v) / total, REPORT_DECIMALS) * 100).alias(v)
                                    for v in PREDICTED_VALUES])


def toxicity_histogram(probs: DataFrame) -> DataFrame:
    """Posts per toxicity band and tenth of the score (M10, R8); a score of 1
    belongs to the last tenth."""
    return (probs.select(S.toxicity_level(F.col("p_negative")).alias("toxicity_level"),
                         F.least(F.floor(F.col("p_negative") * 10), F.lit(9)).cast("int").alias("decile"))
            .groupBy("toxicity_level", "decile").agg(F.count(F.lit(1)).alias("n_posts")))


def batch_loss(model: nb.NBModel, rows: DataFrame, n_train: int, batch_size: int = BATCH_SIZE,
               epochs: int = EPOCHS) -> DataFrame:
    """Evaluation in shuffled batches of ``batch_size``.

    A text without a known token scores with the class priors alone.
    mean_batch_loss is the mean of per-batch means (not weighted by batch
    size); weighted_accuracy is correct / rows; total_steps are the batches
    of the ``n_train`` training rows times the epochs.
    """
    sums = nb.class_sums(model, rows.select("doc_id", "text"), "doc_id", "text", outer=True)
    lg = nb.logits(model, sums)
    pri = model.priors
    lg = lg.select("doc_id", *[F.coalesce(F.col(f"l{c}"), F.lit(pri[c])).alias(f"l{c}") for c in range(3)])
    per_row = (with_batches(rows.select("doc_id", "label"), "doc_id", batch_size)
               .join(lg, "doc_id")
               .select("batch_id",
                       S.cross_entropy(F.col("l0"), F.col("l1"), F.col("l2"), F.col("label")).alias("loss"),
                       (S.argmax3(F.col("l0"), F.col("l1"), F.col("l2")) == F.col("label"))
                       .cast("int").alias("correct")))
    per_batch = per_row.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.sum("loss").alias("loss_sum"),
                                                F.avg("loss").alias("loss_mean"),
                                                F.sum("correct").alias("correct"))
    r6 = lambda c: F.round(c, 6)
    return per_batch.agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_batches"),
        F.lit(-(-n_train // batch_size) * epochs).cast("long").alias("total_steps"),
        r6(F.avg("loss_mean")).alias("mean_batch_loss"),
        r6(F.sum("loss_sum") / F.sum("n")).alias("mean_loss"),
        r6(F.sum("correct") / F.sum("n")).alias("weighted_accuracy"))


def history_rows(model: nb.NBModel, conv: DataFrame) -> DataFrame:
    """Session history entries (A11, T7, T8, P10): one row per successfully
    scored turn with the 50-character preview, rule-A sentiment, band and the
    confidence as percent text. The preview rides along in the scorer's
    group-by, so the long text is never joined back."""
    base = conv.select("conv_id", "turn", "role", T.preview(F.col("text")).alias("preview"), "text")
    pr = K.probabilities(model, K.gate_nonempty(base), ["conv_id", "turn", "role", "preview"], "text")
    app = K.app_fields(pr)
    return app.select("conv_id", "turn", "role", "preview", "sentiment", "toxicity_level",
                      T.percent_text(F.col("confidence")).alias("confidence_text"))
