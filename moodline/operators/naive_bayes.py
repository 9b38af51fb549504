"""Three-class multinomial naive Bayes whose weights are an ordinary table.

Training is two aggregations: token occurrences per class (map-side combined,
so a token that fills a third of the corpus collapses to one row per task
before the shuffle) and the class document counts. Weights are stored wide,
one row per token:

    token, n0, n1, n2, n_occ, w0, w1, w2, wq0, wq1, wq2

``w_c = ln((n_c + a) / (N_c + a * V))`` with ``N_c`` the token occurrences of
class c and ``V`` the vocabulary size; ``wq_c = round(w_c * 1e6)`` as bigint.
Scoring sums ``wq`` over the occurrences of a document: integer sums are
exact, so a document scores bit-identically whatever the partitioning or the
order of the shuffle.

logit_c = prior_c + (sum wq_c / 1e6) / sqrt(known occurrences),
prior_c = ln((docs_c + a) / (docs + 3a)).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodline.functions import text as T
from moodline.operators.joins import checked_lookup_join, materialize

SCALE = 1_000_000
N_CLASSES = 3


@dataclass
class NBModel:
    weights: DataFrame          # materialised, one row per token
    vocab_size: int
    class_docs: tuple[int, int, int]
    class_tokens: tuple[int, int, int]
    alpha: float

    @property
    def counts(self) -> DataFrame:
        """token, n0, n1, n2, n_occ: the training counts, kept in the weights."""
        return self.weights.select("token", *[f"n{c}" for c in range(N_CLASSES)], "n_occ")

    @property
    def priors(self) -> tuple[float, float, float]:
        n = sum(self.class_docs)
        a = self.alpha
        return tuple(math.log((c + a) / (n + N_CLASSES * a)) for c in self.class_docs)


def token_class_counts(train: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    occ = T.token_rows(train, F.col(label).alias("_y"), text=text)
    return occ.groupBy("token").agg(
        *[F.count_if(F.col("_y") == c).alias(f"n{c}") for c in range(N_CLASSES)],
        F.count(F.lit(1)).alias("n_occ"))


def weights_from_counts(counts: DataFrame, class_tokens, vocab_size: int, alpha: float) -> DataFrame:
    cols = []
    for c in range(N_CLASSES):
        w = F.log((F.col(f"n{c}") + F.lit(alpha)) / F.lit(class_tokens[c] + alpha * vocab_size))
        cols.append(w.alias(f"w{c}"))
    out = counts.select("token", *[f"n{c}" for c in range(N_CLASSES)], "n_occ", *cols)
    return out.select("*", *[F.round(F.col(f"w{c}") * SCALE).cast("long").alias(f"wq{c}")
                             for c in range(N_CLASSES)])


def fit(train: DataFrame, alpha: float = 1.0, text: str = "text", label: str = "label",
        counts: DataFrame | None = None, class_docs: dict[int, int] | None = None) -> NBModel:
    """Train on rows (text, label in 0..2). ``counts`` may be passed when
    several models share one count table (model selection), ``class_docs``
    (documents of each label) when they are known."""
    if counts is None:
        counts = materialize(token_class_counts(train, text, label))
    totals = counts.agg(F.count(F.lit(1)).alias("v"),
                        *[F.coalesce(F.sum(f"n{c}"), F.lit(0)).alias(f"t{c}") for c in range(N_CLASSES)]
                        ).first()
    docs = class_docs if class_docs is not None else {
        r["_y"]: r["n"] for r in
        train.groupBy(F.col(label).alias("_y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    weights = weights_from_counts(counts, [totals[f"t{c}"] for c in range(N_CLASSES)],
                                  totals["v"], alpha)
    return NBModel(weights=weights, vocab_size=int(totals["v"]),
                   class_docs=tuple(int(docs.get(c, 0)) for c in range(N_CLASSES)),
                   class_tokens=tuple(int(totals[f"t{c}"]) for c in range(N_CLASSES)),
                   alpha=alpha)


def class_sums(model: NBModel, docs: DataFrame, key="doc_id", text: str = "text",
               outer: bool = False) -> DataFrame:
    """keys..., s0, s1, s2 (bigint), n_known: weights summed over the known
    token occurrences of each text.

    ``key`` may be a list: small per-row columns (platform, a preview) ride
    along in the one group-by instead of being joined back afterwards.
    With ``outer`` every input row is kept; rows with no known token (or a
    null / empty text) get n_known = 0 and null sums.
    """
    keys = [key] if isinstance(key, str) else list(key)
    occ = (docs.select(*keys, F.explode_outer(T.tokens(F.col(text))).alias("token")) if outer
           else T.token_rows(docs, *keys, text=text))
    w = model.weights.select("token", "wq0", "wq1", "wq2", "n_occ")
    joined = checked_lookup_join(occ, w, "token", model.vocab_size,
                                 how="left" if outer else "inner")
    return joined.groupBy(*keys).agg(F.sum("wq0").alias("s0"), F.sum("wq1").alias("s1"),
                                     F.sum("wq2").alias("s2"), F.count("wq0").alias("n_known"))


def logits(model: NBModel, sums: DataFrame) -> DataFrame:
    """Adds l0, l1, l2 to the output of ``class_sums``."""
    priors = model.priors
    norm = F.sqrt(F.col("n_known").cast("double"))  # null sums stay null
    return sums.select("*", *[(F.lit(priors[c]) + F.col(f"s{c}").cast("double") / F.lit(float(SCALE)) / norm)
                              .alias(f"l{c}") for c in range(N_CLASSES)])
