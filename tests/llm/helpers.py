"""Shared fixtures: a small table with every awkward row, and its variants."""

from __future__ import annotations

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward_rows() -> list[tuple]:
    long_text = " ".join(f"word{i % 97} und der the of {i}" for i in range(6000))
    near = "one of the many words that make this text a long enough text to have a stable print " * 4
    rows = [
        (1, "The quick brown fox jumps over the lazy dog and the cat", "en", "src0", 54),
        (2, "the QUICK brown fox jumps over the lazy dog and the cat", "en", "src0", 54),
        (3, "Der schnelle braune Fuchs springt über den faulen Hund", "de", None, 54),
        (4, None, None, None, None), (5, "", "en", "src1", 0), (6, "", None, "src1", 0),
        (7, "   \t\n ", "fr", "src1", 6), (8, "1234 !!! ###", None, "src2", 12),
        (9, near, "en", "src0", len(near)), (10, near + "end", "en", "src0", len(near) + 3),
        (11, long_text, "en", "src0", len(long_text)), (12, long_text, "en", "src0", len(long_text)),
        (13, "mail a.b@example.com or +1 (212) 555-1234 from 10.0.0.1 card 4111 1111 1111 1111", "en", "src3", 80),
        (14, "Released under the MIT License. SPDX-License-Identifier: MIT OR Apache-2.0", "en", "src3", 74),
        (None, "a row without an id, in two copies", "en", None, 34),
        (None, "a row without an id, in two copies", "en", None, 34),
        (15, "repeated row", "en", "src0", 12), (15, "repeated row", "en", "src0", 12),
        (16, "\u0000 null character, emoji 😀 and 漢字", None, "src0", 33),
    ]
    return rows


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA)


def clashing(spark):
    """The same rows with extra columns that operators might use themselves."""
    from pyspark.sql import functions as F
    names = ["kept", "keep_id", "h", "id", "fp", "size", "spans", "_slot", "_t", "_len", "rule", "row_hash", "_w",
             "score", "lang_pred", "ids", "key", "_n", "shard", "slot", "_b"]
    return awkward(spark).withColumns({n: F.lit("x") for n in names})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def tables(spark, tmp_path, docs, labels=None) -> str:
    """A folder with documents.parquet and labels.parquet for the queries."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    if labels is None:
        labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)
