"""Per-row math on three class scores (M1-M13), all native expressions.

Logits and probabilities are three scalar columns inside the plan, which keeps
every step inside whole-stage codegen; arrays / maps / structs are built only
at the edge (``result_struct``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from moodline.functions import text as T
from moodline.functions.labels import CLASS_NAMES

# Toxicity bands on the negative-class probability.
HIGH = 0.7
MODERATE = 0.4
# Probabilities are rounded to this many decimals before any threshold, so that
# a different summation order on another cluster cannot flip a band.
STABLE_DECIMALS = 9


def softmax3(l0: Column, l1: Column, l2: Column) -> tuple[Column, Column, Column]:
    m = F.greatest(l0, l1, l2)
    e0, e1, e2 = F.exp(l0 - m), F.exp(l1 - m), F.exp(l2 - m)
    s = e0 + e1 + e2
    return e0 / s, e1 / s, e2 / s


def stable(p: Column) -> Column:
    return F.round(p, STABLE_DECIMALS)


def gt(x: Column, threshold: float) -> Column:
    """Python's ``x > t``: NaN compares false (in Spark NaN > t is true)."""
    return (x > F.lit(threshold)) & ~F.isnan(x)


def argmax3(p0: Column, p1: Column, p2: Column) -> Column:
    """Index of the largest value, first index on ties (torch.argmax)."""
    return F.when((p0 >= p1) & (p0 >= p2), F.lit(0)).when(p1 >= p2, F.lit(1)).otherwise(F.lit(2))


def top_two(p0: Column, p1: Column, p2: Column) -> tuple[Column, Column]:
    """Largest and second largest of three (descending sort, first two)."""
    first = F.greatest(p0, p1, p2)
    second = F.greatest(F.least(p0, p1), F.least(p1, p2), F.least(p0, p2))
    return first, second


def confidence(p0: Column, p1: Column, p2: Column) -> Column:
    """p1 / (p1 + p2) of the sorted probabilities, in [0.5, 1]."""
    a, b = top_two(p0, p1, p2)
    return a / (a + b)


def sentiment_rule_a(neg: Column, neu: Column, pos: Column) -> Column:
    """Interactive rule: thresholds on negative and positive only."""
    return (F.when(gt(neg, MODERATE) & (neg > pos), F.lit("Negative"))
            .when(gt(pos, MODERATE) & (pos > neg), F.lit("Positive"))
            .otherwise(F.lit("Neutral")))


def sentiment_rule_b(neg: Column, neu: Column, pos: Column) -> Column:
    """Batch rule: name of the arg-max class."""
    names = F.array(*[F.lit(n) for n in CLASS_NAMES])
    return F.element_at(names, argmax3(neg, neu, pos) + 1)


def toxicity_level(score: Column) -> Column:
    return (F.when(gt(score, HIGH), F.lit("High"))
            .when(gt(score, MODERATE), F.lit("Moderate"))
            .otherwise(F.lit("Low")))


def raw_scores_map(neg: Column, neu: Column, pos: Column) -> Column:
    return F.create_map(F.lit("Negative"), T.percent_text(neg),
                        F.lit("Neutral"), T.percent_text(neu),
                        F.lit("Positive"), T.percent_text(pos))


def cross_entropy(l0: Column, l1: Column, l2: Column, label: Column) -> Column:
    """-ln softmax(l)[label] = logsumexp(l) - l[label]."""
    m = F.greatest(l0, l1, l2)
    lse = m + F.log(F.exp(l0 - m) + F.exp(l1 - m) + F.exp(l2 - m))
    chosen = F.when(label == 0, l0).when(label == 1, l1).otherwise(l2)
    return lse - chosen
