"""Label names and codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from moodline.functions import text as T

# Class order and names of the three-class model.
CLASS_NAMES = ["Negative", "Neutral", "Positive"]
# Label words accepted after strip + lower, and their codes.
LABEL_CODES = {"negative": 0, "neutral": 1, "positive": 2}


def standardize_label(raw: Column) -> Column:
    """strip (Python semantics) then lower, as the training clean-up does."""
    return F.lower(T.py_strip(raw))


def label_to_code(raw: Column) -> Column:
    """Known words -> 0/1/2, anything else -> null (dropped later)."""
    mapping = F.create_map(*[x for k, v in LABEL_CODES.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(mapping, standardize_label(raw))


def code_to_label(code: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(n) for n in CLASS_NAMES]), code + 1)
