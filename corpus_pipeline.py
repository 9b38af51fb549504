"""The corpus pipeline: language ID, exact dedup, SimHash near-dedup, PII
masking, packing. Every stage takes (spark, docs, sf_dir) and returns a
DataFrame; ``run`` writes each stage's rows as Parquet and reads them again.
All stages but the last return the columns of their input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from moodline.llm import langid, packing, pii, simhash
from moodline.llm.common import documents, keep_rows, row_hash, written
from moodline.llm.exact_dedup import exact_dedup


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: texts without a letter (null and empty ones too) and texts
    like no learned language go (``langid.least_score``: short ones stay). The
    profiles are learned from ``docs``."""
    return langid.keep_language(docs, langid.train(docs))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of equal texts the row with the largest doc_id stays."""
    decided = exact_dedup(docs, carry={"row_hash": row_hash(docs["text"])})
    return keep_rows(docs, decided.filter("kept"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each group linked by fingerprints (4-word shingles, at
    most 4 differing bits) the document with the smallest doc_id stays. Rows
    without a doc_id stay only in groups where no row has one."""
    groups = simhash.near_dedup(docs, shingle=4, max_bits=4)
    return keep_rows(docs, groups.filter(groups["doc_id"].eqNullSafe(groups["component_id"])))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: personal data is masked in the texts; no row goes."""
    return pii.mask_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: the pieces of the packed sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_stage), ("exact_dedup", exact_stage), ("simhash_near_dedup", near_stage),
          ("pii", pii_stage), ("packing", packing_stage)]
#: Language profiles, fingerprints and packing have no SQL form; the stages are
#: tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last stage."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
