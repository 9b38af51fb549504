"""The registered queries: names, awkward tables, empty tables, SQL."""

import os

import helpers
import pytest
from helpers import MEDIUM, SMALL
from oracle_check import compare, duck

import __spark_entry__ as E
from moodline.llm import queries as L

COLUMNS = {
    "op1_simhash": ["doc_id", "fingerprint", "component_id"],
    "op2_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op3_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op4_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                          "base_failed", "kept"],
    "op5_sentencepiece": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op6_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op7_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op8_license_scan": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    "op9_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op10_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
}
#: A query of groups, not of rows.
GROUPED = {"op11_source_divergence": ["lang", "source", "part", "item", "value", "rank"]}
#: Queries of other tables than documents: table, columns.
OTHERS = {
    "op12_warc": ("pages", "page_id long, url string, html string",
                  ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]),
    "op13_hard_negatives": ("embeddings", "vec_id long, embedding array<float>, label int",
                            ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]),
}


def test_all_are_registered():
    assert set(L.QUERIES) | {"pipeline"} <= set(E.queries())
    assert set(L.QUERIES) == set(COLUMNS) | set(GROUPED) | set(OTHERS)


@pytest.mark.parametrize("name", sorted(OTHERS))
def test_empty_other_table(spark, tmp_path, name):
    table, schema, columns = OTHERS[name]
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{table}.parquet")
    got = L.QUERIES[name](spark, str(tmp_path))
    assert got.columns == columns and got.count() == 0


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_awkward_rows_with_clashing_columns(spark, tmp_path, name):
    docs = helpers.clashing(spark)
    path = helpers.tables(spark, tmp_path, docs)
    got = L.QUERIES[name](spark, path)
    assert set(COLUMNS[name]) <= set(got.columns)
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got.select("doc_id").collect())
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in docs.select("doc_id").collect())
    if name == "op7_packing":  # a document may lie in several pieces
        assert set(ids) == set(want)
    else:
        assert ids == want


@pytest.mark.parametrize("name", sorted(COLUMNS | GROUPED))
def test_empty_table(spark, tmp_path, name):
    path = helpers.tables(spark, tmp_path, helpers.empty(spark))
    got = L.QUERIES[name](spark, path)
    assert set((COLUMNS | GROUPED)[name]) <= set(got.columns) and got.count() == 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables not present")
@pytest.mark.parametrize("name", sorted(L.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    where = MEDIUM if os.path.isdir(MEDIUM) else SMALL
    ok, msg = compare(spark, duck(where), name, L.QUERIES[name], L.ORACLE_SQL[name], where)
    assert ok, msg
