"""Model choice by validation accuracy (A10).

Candidates are smoothing values, numbered like training epochs. All of them
are trained from one token-count table and judged in one scoring pass: the
weights table carries one quantised column per class and candidate.
The best is the first candidate reaching the maximal accuracy; if no
candidate is above 0, the last one.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moodline.functions import scoring as S
from moodline.functions import text as T
from moodline.operators import naive_bayes as nb
from moodline.operators.joins import checked_lookup_join, materialize

CANDIDATE_ALPHAS = [0.1, 0.5, 1.0, 2.0]


def select_alpha(train: DataFrame, test: DataFrame, alphas=CANDIDATE_ALPHAS,
                 counts: DataFrame | None = None, class_docs: dict[int, int] | None = None) -> DataFrame:
    """``counts`` (token, n0..n2, n_occ of ``train``) and ``class_docs`` may
    come from a model already trained on ``train``; else they are counted."""
    if counts is None:
        counts = materialize(nb.token_class_counts(train))
    totals = counts.agg(F.count(F.lit(1)).alias("v"),
                        *[F.coalesce(F.sum(f"n{c}"), F.lit(0)).alias(f"t{c}") for c in range(3)]).first()
    docs = class_docs if class_docs is not None else {
        r["_y"]: r["n"] for r in train.groupBy(F.col("label").alias("_y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    v = int(totals["v"])
    n_docs = sum(docs.values())
    cols = []
    for k, a in enumerate(alphas):
        for c in range(3):
            w = F.log((F.col(f"n{c}") + F.lit(a)) / F.lit(totals[f"t{c}"] + a * v))
            cols.append(F.round(w * nb.SCALE).cast("long").alias(f"wq{c}_{k}"))
    weights = materialize(counts.select("token", "n_occ", *cols))
    occ = test.select("doc_id", "label", F.explode_outer(T.tokens(F.col("text"))).alias("token"))
    joined = checked_lookup_join(occ, weights, "token", v, how="left")
    sums = joined.groupBy("doc_id", "label").agg(
        F.count("n_occ").alias("n_known"),
        *[F.sum(f"wq{c}_{k}").alias(f"s{c}_{k}") for k in range(len(alphas)) for c in range(3)])
    norm = F.sqrt(F.col("n_known").cast("double"))
    per_candidate = []
    for k, a in enumerate(alphas):
        pri = [math.log((docs.get(c, 0) + a) / (n_docs + 3 * a)) for c in range(3)]
        lg = [F.lit(pri[c]) + F.coalesce(F.col(f"s{c}_{k}").cast("double") / F.lit(float(nb.SCALE)) / norm,
                                         F.lit(0.0)) for c in range(3)]
        per_candidate.append(F.struct(F.lit(k + 1).alias("epoch"), F.lit(float(a)).alias("alpha"),
                                      (S.argmax3(*lg) == F.col("label")).cast("int").alias("correct")))
    long = sums.select(F.explode(F.array(*per_candidate)).alias("c")).select("c.*")
    acc = long.groupBy("epoch", "alpha").agg((F.sum("correct") / F.count(F.lit(1))).alias("val_accuracy"))
    return mark_best(acc)


def mark_best(acc: DataFrame) -> DataFrame:
    """Adds ``is_best`` to a table of (epoch, ..., val_accuracy): the first
    epoch reaching the maximal accuracy; the last epoch if none is above 0.
    One row per candidate, so the un-partitioned window sees a handful of
    rows."""
    every = Window.partitionBy(F.lit(0))
    best_acc = F.max("val_accuracy").over(every)
    first_best = F.min(F.when(F.col("val_accuracy") == best_acc, F.col("epoch"))).over(every)
    best = F.when(best_acc > 0, first_best).otherwise(F.max("epoch").over(every))
    return acc.select("*", (F.col("epoch") == best).alias("is_best"))
