"""Scoring with the weights table.

Plan shape of ``score_texts``: scan -> regexp tokens -> explode -> lookup join
with the weights (broadcast when the counted vocabulary fits, otherwise
hot/cold split) -> partial sum per text inside the scan stage -> one shuffle
of one row per text -> softmax and bands as projections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodline.functions import scoring as S
from moodline.operators import naive_bayes as nb
from moodline.operators.batch_predict import can_score_in_place, sums_in_place
from moodline.operators.joins import broadcast_bound, checked_lookup_join, materialize

#: Default advice by toxicity band; a caller may pass rows of its own.
ADVICE = [
    ("High", "Hold this post back: a moderator should read it first. Would you say it to the person's face?"),
    ("Moderate", "Read this aloud once before posting; a softer opening often gets a better answer."),
    ("Low", "Nothing to change here."),
]

PROB_COLS = ["p_negative", "p_neutral", "p_positive"]


def probabilities(model: nb.NBModel, docs: DataFrame, key="doc_id",
                  text: str = "text", outer: bool = False, in_place: bool = False) -> DataFrame:
    """keys, n_known, l0..l2, p_negative, p_neutral, p_positive for every text
    with at least one known token (``outer``: for every row, nulls when it
    cannot be scored). Probabilities are rounded to ``STABLE_DECIMALS`` so
    that thresholds are reproducible. ``in_place``: score each text in the
    task that read it (K2) if the model is within the broadcast bounds; the
    keys may then be wide, as nothing is shuffled."""
    keys = [key] if isinstance(key, str) else list(key)
    if in_place and can_score_in_place(model):
        sums = sums_in_place(model, docs, keys, text)
        sums = sums.select(*keys, *[F.when(F.col("n_known") > 0, F.col(c)).alias(c) for c in ("s0", "s1", "s2")],
                           F.coalesce("n_known", F.lit(0)).alias("n_known"))
        lg = nb.logits(model, sums if outer else sums.filter("n_known > 0"))
    else:
        lg = nb.logits(model, nb.class_sums(model, docs, keys, text, outer))
    p0, p1, p2 = S.softmax3(F.col("l0"), F.col("l1"), F.col("l2"))
    return lg.select(*keys, "n_known", "l0", "l1", "l2",
                     S.stable(p0).alias("p_negative"), S.stable(p1).alias("p_neutral"),
                     S.stable(p2).alias("p_positive"))


def _p():
    return F.col("p_negative"), F.col("p_neutral"), F.col("p_positive")


def app_fields(df: DataFrame) -> DataFrame:
    """The interactive result record as columns: rule-A sentiment, toxicity
    score / level, confidence, advice, percent texts."""
    n, u, p = _p()
    return df.select(
        "*",
        S.sentiment_rule_a(n, u, p).alias("sentiment"),
        n.alias("toxicity_score"),
        S.toxicity_level(n).alias("toxicity_level"),
        S.confidence(n, u, p).alias("confidence"))


def batch_fields(df: DataFrame) -> DataFrame:
    """The batch result: rule-B (arg-max) sentiment and confidence."""
    n, u, p = _p()
    return df.select("*", S.argmax3(n, u, p).alias("predicted_code"),
                     S.sentiment_rule_b(n, u, p).alias("predicted"),
                     S.confidence(n, u, p).alias("confidence"))


def advice_table(spark, advice: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row for each of the three bands: broadcast by construction."""
    return spark.createDataFrame(advice or ADVICE, "toxicity_level string, suggestions string")


def with_advice(df: DataFrame) -> DataFrame:
    return df.join(F.broadcast(advice_table(df.sparkSession)), "toxicity_level", "left")


def result_struct(df: DataFrame) -> Column:
    """The full app record (M14) as one struct with array and map fields."""
    n, u, p = _p()
    return F.struct(
        F.col("sentiment"), F.col("toxicity_score"), F.col("toxicity_level"),
        F.col("confidence"), F.col("suggestions"),
        F.array(n, u, p).alias("probabilities"),
        S.raw_scores_map(n, u, p).alias("raw_scores"))


def error_fallback(predicted: Column, conf: Column, probs: Column) -> Column:
    """Batch record with the failure fallback (M15): 'Error', 0.0, [0,0,0]."""
    ok = F.struct(predicted.alias("sentiment"), conf.alias("confidence"), probs.alias("probabilities"))
    err = F.struct(F.lit("Error").alias("sentiment"), F.lit(0.0).alias("confidence"),
                   F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("probabilities"))
    return F.when(predicted.isNull(), err).otherwise(ok)


def score_with_errors(model: nb.NBModel, docs: DataFrame, key="doc_id",
                      text: str = "text") -> DataFrame:
    """Every input row keeps its place: texts that cannot be scored (null,
    empty or without any known token) get the fallback record (M15)."""
    keys = [key] if isinstance(key, str) else list(key)
    scored = batch_fields(probabilities(model, docs, keys, text, outer=True))
    ok = F.col("n_known") > 0
    r = error_fallback(F.when(ok, F.col("predicted")), F.col("confidence"),
                       F.array(*[F.col(c) for c in PROB_COLS]))
    return scored.select(*keys, r.alias("r")).select(*keys, "r.*")


def score_distinct(model: nb.NBModel, docs: DataFrame, key: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """Each distinct text is scored once (K3), then the result is joined back
    to all rows carrying that text.

    Texts are keyed by their 256-bit hash. Everything that decides which rows
    are scored is narrow: the written (row key, hash) table gives one
    representative per text (its smallest key, a partial aggregate, so a
    text copied into a third of all rows is one row per task before the
    shuffle). The text rows are then filtered where they are read, by a
    broadcast semi-join with the representatives' keys, or else an
    anti-join with the copies' keys, whichever set was counted within the
    bound; only when both are beyond it is the text shuffled to the
    representatives. Scores are written once per text and joined back on
    the hash, with the hottest texts broadcast (size-checked).
    """
    bound = broadcast_bound(docs.sparkSession)
    present = gate_nonempty(docs, text)
    hashes = materialize(present.select(key, F.sha2(F.col(text), 256).alias("_th")))
    reps = materialize(hashes.groupBy("_th").agg(F.min(key).alias("_rep"),
                                                 F.count(F.lit(1)).alias("_n_dup")))
    n_reps = reps.count()
    rows = present.select(key, text)
    rep_keys = reps.select(F.col("_rep").alias(key))
    if n_reps <= bound:
        uniq = rows.join(F.broadcast(rep_keys), key, "left_semi")
    else:
        # a row is a copy when its text has a smaller representative key;
        # the lookup on the hash splits hot texts off into a broadcast
        copies = materialize(checked_lookup_join(hashes, reps, "_th", n_reps)
                             .filter(F.col(key) != F.col("_rep")).select(key))
        n_copies = copies.count()
        uniq = (rows.join(F.broadcast(copies), key, "left_anti") if n_copies <= bound
                else rows.join(rep_keys, key, "left_semi"))
    per_text = probabilities(model, uniq.select(F.sha2(F.col(text), 256).alias("_th"), text), "_th", text)
    per_text = per_text.select("_th", *PROB_COLS)
    if n_reps <= bound:
        # at most n_reps scored texts: the join back is a broadcast
        return hashes.join(F.broadcast(materialize(per_text)), "_th").select(key, *PROB_COLS)
    # one row per text on both sides: a join without hot keys
    scored = materialize(per_text.join(reps.select("_th", "_n_dup"), "_th"))
    back = checked_lookup_join(hashes, scored, "_th", scored.count())
    return back.select(key, *PROB_COLS)


def gate_nonempty(df: DataFrame, text: str = "text") -> DataFrame:
    """The input gate: empty or missing text is not scored (whitespace is).
    Posts carry the equivalent ``has_text`` flag, which is cheaper to test."""
    if "has_text" in df.columns:
        return df.filter(F.col("has_text"))
    return df.filter(F.char_length(F.col(text)) > 0)

