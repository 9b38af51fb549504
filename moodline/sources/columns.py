"""Column discovery on an input whose names are not known in advance.

Runs on ``df.columns`` in the driver (no data is read): the first column, in
column order, whose lower-cased name contains the fragment. Text and label
are required; platform is optional.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Name fragments of the standard columns, and their new names.
TEXT_HINT, LABEL_HINT, PLATFORM_HINT = "text", "sentiment", "platform"
TEXT_NAME, LABEL_NAME, PLATFORM_NAME = "Text", "Sentiment", "Platform"


def find_column(columns: list[str], fragment: str) -> str | None:
    return next((c for c in columns if fragment in c.lower()), None)


def standardize(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Keep the discovered columns renamed to Text, Sentiment and (when
    found) Platform, plus ``keep`` unchanged. One select, so a column that
    matches two fragments is simply selected twice under two names."""
    cols = df.columns
    text, label = find_column(cols, TEXT_HINT), find_column(cols, LABEL_HINT)
    if text is None or label is None:
        raise ValueError(f"required text / sentiment columns not found in {cols}")
    platform = find_column(cols, PLATFORM_HINT)
    out = [F.col(k) for k in keep or []]
    out += [F.col(text).alias(TEXT_NAME), F.col(label).alias(LABEL_NAME)]
    if platform is not None:
        out.append(F.col(platform).alias(PLATFORM_NAME))
    return df.select(*out)
