"""String functions with Python ``str`` / ``re`` semantics.

Java's ``\\w`` and ``\\s`` are ASCII-only while Python's are Unicode; the
classes below reproduce Python's over all code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Python's Unicode \w and str.isspace() as Java regex classes.
WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
MENTION = "@" + WORD + "+" + SPACE + "*"
# Texts that the clean-up empties: only whitespace and '@word' runs. Anchored
# and possessive, so an ordinary text fails at its first character.
BLANK_AFTER_CLEANUP = "^(?:" + SPACE + "|@" + WORD + "++)*+\\z"
PREVIEW_CHARS = 50


def py_strip(c: Column) -> Column:
    """``str.strip()``: Spark's trim removes U+0020 only. A run of blanks is
    tried from its first character only, so long inner runs cost linear time."""
    return F.regexp_replace(c, "^" + SPACE + "++|(?<!" + SPACE + ")" + SPACE + r"++\z", "")


def remove_mentions(c: Column) -> Column:
    """Delete each '@' + word characters + trailing whitespace, then strip.

    null stays null; a bare '@' stays; in an e-mail address the part from '@'
    to the next non-word character goes.
    """
    return py_strip(F.when(c.contains("@"), F.regexp_replace(c, MENTION, "")).otherwise(c))


def has_content(c: Column) -> Column:
    """True exactly when ``remove_mentions(c)`` is neither null nor empty,
    without running the clean-up: one anchored match that stops at the first
    character that is neither whitespace nor part of a mention."""
    return c.isNotNull() & ~c.rlike(BLANK_AFTER_CLEANUP)


def has_mention(c: Column) -> Column:
    """``.str.contains('@', na=False)``: any '@', null counts as false."""
    return F.coalesce(c.contains("@"), F.lit(False))


def capitalize(c: Column) -> Column:
    """``str.capitalize()``: first character upper, all others lower."""
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substring(c, 2, 2147483647)))


def preview(c: Column, n: int = PREVIEW_CHARS) -> Column:
    """First n code points + '...' when longer than n."""
    return F.when(F.char_length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def percent_text(p: Column) -> Column:
    """``f"{p:.1%}"``: half-even on the binary value, like Python."""
    return F.concat(F.format_number(p * 100, 1), F.lit("%"))


def token_rows(df: DataFrame, *keep: str | Column, text: str = "text") -> DataFrame:
    """``keep`` columns and ``token``, one row per token; texts without tokens
    have none. An outer explode and a filter behind it: for an inner one the
    optimizer adds a size check of the token array, which it pushes down, so
    that the regex would run twice."""
    rows = df.select(*keep, F.explode_outer(tokens(F.col(text))).alias("token"))
    return rows.filter(F.col("token").isNotNull())


def tokens(c: Column) -> Column:
    """Word runs of the lower-cased text, in order, whole text."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD + "+"), 0)
