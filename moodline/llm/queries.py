"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodline.llm.common import documents
from moodline.sources.tables import read_table


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``bytes``: minimax contiguous partition of the equal-text groups."""
    from moodline.llm.sharding import shard_documents
    out = shard_documents(documents(spark, sf_dir), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4-word shingles, links of at most 4 differing bits."""
    from moodline.llm.simhash import hex_fingerprint, near_dedup
    out = near_dedup(documents(spark, sf_dir), shingle=4, max_bits=4)
    return out.select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from moodline.llm.langid import identify, is_held_out, train
    docs = documents(spark, sf_dir)
    out = identify(docs, train(docs))
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """200-byte strings that start at two places are removed at both."""
    from moodline.llm.substrings import remove_repeats
    out = remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision list learned from ``labels``, applied to every document."""
    from moodline.llm.quality import judge, learn
    docs = documents(spark, sf_dir)
    rules = learn(docs, read_table(spark, sf_dir, "labels"))
    return judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                     "n_repeat_words", "base_failed", "kept", "rule")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from moodline.llm.pieces import digest_documents
    return digest_documents(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from moodline.llm.packing import pack
    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from moodline.llm.licenses import scan_licenses
    out = scan_licenses(documents(spark, sf_dir))
    return out.withColumns({"base_labels": F.array_join("base_labels", ","), "labels": F.array_join("labels", ",")})


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from moodline.llm.pii import find_pii
    out = find_pii(documents(spark, sf_dir))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone",
                      F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from moodline.llm.common import ascii_lower
    from moodline.llm.exact_dedup import exact_dedup
    digest = F.sha2(ascii_lower(F.col("text")), 256)
    return exact_dedup(documents(spark, sf_dir), carry={"text_sha256": digest}).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of at least 10 documents of the language; 10 terms a source."""
    from moodline.llm.divergence import audit
    return audit(documents(spark, sf_dir))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages in the shared folder, read back."""
    from moodline.llm.warc import read_archives, write_archives
    from moodline.session import scratch_path
    path = scratch_path(spark, "warc")
    write_archives(read_table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five positives, ten negatives of 30 to 90 percent of their score."""
    from moodline.llm.negatives import mine_negatives
    return mine_negatives(read_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_language_id": op2_language_id,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_sentencepiece": op5_sentencepiece,
    "op7_packing": op7_packing,
    "op8_license_scan": op8_license_scan,
    "op10_pii": op10_pii,
    "op6_sharding": op6_sharding,
    "op9_exact_dedup": op9_exact_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_warc": op12_warc,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept,
               sha256(norm) AS text_sha256
        FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                       'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
    """,
    "op11_source_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents),
        w AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
        kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM w GROUP BY lang, term
                 HAVING count(DISTINCT row) >= 10),
        l AS (SELECT lang, sum(n) AS n, CAST(count(*) AS HUGEINT) AS v FROM kept GROUP BY lang),
        c AS (SELECT w.lang, source, term, CAST(count(*) AS HUGEINT) AS n
              FROM w JOIN kept USING (lang, term) GROUP BY w.lang, source, term),
        g AS (SELECT d.lang, d.source, coalesce(any_value(t.n), 0) AS n
              FROM (SELECT DISTINCT lang, source FROM d) d
              LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source) t USING (lang, source)
              GROUP BY d.lang, d.source),
        p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS c,
                     1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (g.n + 2 * l.v) AS p,
                     1 + (1000000000 * (k.n + 2)) // (l.n + 2 * l.v) AS q
              FROM g JOIN kept k ON k.lang = g.lang JOIN l ON l.lang = g.lang
              LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
              FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
              GROUP BY a.lang, a.source, b.source),
        r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
              FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
              LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
              UNION ALL
              SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE c > 0 AND p > q),
        ranked AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
                          CAST(row_number() OVER (PARTITION BY lang, source, part
                                                  ORDER BY value DESC, encode(item)) AS INTEGER) AS rank
                   FROM r)
        SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
    """,
    "op12_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS size
                   FROM pages),
        r AS (SELECT *, CASE WHEN size >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS target FROM p)
        SELECT page_id, size AS payload_bytes, sha1(html) AS payload_digest,
               CASE WHEN target IS NULL OR target IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END
                   AS record_type,
               CASE WHEN target IS DISTINCT FROM page_id THEN target END AS refers_to
        FROM r
    """,
    "op13_hard_negatives": """
        WITH v AS (
            SELECT row_number() OVER () AS row, vec_id,
                   CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.row AS anchor, a.vec_id AS anchor_id, a.label = b.label AS same, b.row, b.vec_id,
                   list_sum(list_transform(list_zip(a.c, b.c), lambda z: z[1] * z[2])) AS score
            FROM v a JOIN v b ON a.row <> b.row
            WHERE a.vec_id % 100 = 0),
        p AS (
            SELECT * FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST, row) <= 5)
        SELECT s.anchor_id, p.vec_id AS positive_id,
               CAST(row_number() OVER (PARTITION BY anchor, p.row
                                       ORDER BY s.score DESC, s.vec_id NULLS LAST, s.row) AS INTEGER) AS rank,
               s.vec_id AS negative_id, CAST(p.score AS BIGINT) AS positive_score,
               CAST(s.score AS BIGINT) AS negative_score
        FROM s JOIN p USING (anchor)
        WHERE NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
        QUALIFY rank <= 10
    """,
}
