"""Readers for the input tables: cleaned documents without labels (what
scoring reads), the narrow label table, and posts = documents + labels.

The posts of the jobs are ``documents`` rows: text = ``documents.text``,
platform = ``documents.source``, row key = ``doc_id``. Human labels come from
``labels``: toxic -> Negative, else low quality -> Neutral, else Positive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodline.functions import text as T
from moodline.functions.labels import CLASS_NAMES
from moodline.operators.joins import checked_lookup_join
from moodline.session import hadoop_path


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def input_state(spark: SparkSession, sf_dir: str, *names: str) -> tuple:
    """(name, path, length, modification time) of the files of tables: the key
    under which derived tables are remembered, so replaced input is noticed."""
    out = []
    for name in names:
        fs, path = hadoop_path(spark, table_path(sf_dir, name))
        files = fs.listFiles(path, True)
        while files.hasNext():
            f = files.next()
            out.append((name, f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def read_keyed(spark: SparkSession, sf_dir: str, name: str, key: str | list[str],
               *columns: str, always: bool = False) -> DataFrame:
    """Read ``columns`` of a table, spread over the cluster by ``key`` (a
    unique row key, so that no single value can fill one partition) only
    when the scan arrives in fewer splits than the cluster has cores.

    On a cluster a large table is read in many splits (one per row group /
    ``spark.sql.files.maxPartitionBytes``) and is processed where it is read:
    its text is never shuffled just to be tokenized. A table stored in a few
    large row groups (the local test tables are one row group each) would
    leave all per-row regex work to one task; it is hash-partitioned by key
    instead, and the per-key aggregations and windows downstream reuse that
    partitioning. The decision reads file metadata only (no job).

    ``always`` partitions by key in any case: for jobs that regroup the rows
    of each key downstream (per-text token arrays, text joined back to its
    scores), moving the text once is cheaper than moving its token rows.
    """
    df = read_table(spark, sf_dir, name)
    if columns:
        df = df.select(*columns)
    if always:
        return df.repartition(*([key] if isinstance(key, str) else key))
    return spread(df, key)


def spread(df: DataFrame, key: str | list[str]) -> DataFrame:
    """``df`` as it is when it already has at least one partition per core,
    otherwise hash-partitioned by ``key`` into ``spark.sql.shuffle.partitions``
    (AQE coalesces them at run time)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(*([key] if isinstance(key, str) else key))


def label_code(toxic: Column, quality: Column) -> Column:
    """0 Negative / 1 Neutral / 2 Positive from the two flags of ``labels``."""
    return (F.when(toxic == 1, F.lit(0))
            .when(quality == 0, F.lit(1))
            .when(quality.isNotNull(), F.lit(2)))


def raw_label_text(code: Column, key: Column) -> Column:
    """Human label as typed: padded, mixed case, sometimes an unknown word.

    The variant is a fixed function of the row key (first hex digit of its
    md5), so every engine derives the same strings.
    """
    name = F.element_at(F.array(*[F.lit(n) for n in CLASS_NAMES]), code + 1)
    digit = F.substring(F.md5(key.cast("string")), 1, 1)
    return (F.when(code.isNull(), F.lit(None).cast("string"))
            .when(digit.isin("0", "1", "2", "3"), name)
            .when(digit.isin("4", "5", "6"), F.concat(F.lit(" "), name, F.lit("  ")))
            .when(digit.isin("7", "8", "9"), F.upper(name))
            .when(digit.isin("a", "b", "c"), F.lower(name))
            .when(digit == "d", F.concat(F.lit("  "), F.upper(name), F.lit(" ")))
            .when(digit == "e", F.concat(F.lit("very "), F.lower(name)))
            .otherwise(F.lit("unsure")))


def documents_clean(spark: SparkSession, sf_dir: str, keyed: bool = False) -> DataFrame:
    """One row per post, no labels: doc_id, original_text, text (mentions
    removed, '' -> null as after the CSV hop), has_text (text is not null,
    decided without the clean-up regex: filters on it are cheap and are
    pushed towards the scan), platform.

    Scoring reads this and attaches labels, if at all, to its narrow per-post
    result rows, so the text never travels to a label join. ``keyed``: hash-
    partitioned by doc_id in any case (see ``read_keyed``)."""
    docs = read_keyed(spark, sf_dir, "documents", "doc_id", "doc_id", "text", "source",
                      always=keyed)
    return clean_columns(docs)


def clean_columns(docs: DataFrame, *keep: str) -> DataFrame:
    """The clean-up projection of ``documents_clean`` over raw (doc_id, text,
    source, keep...) rows; applied after a top-n or a join that keeps few
    rows, it cleans only the rows kept."""
    has_text = T.has_content(F.col("text"))
    return docs.select("doc_id", F.col("text").alias("original_text"),
                       F.when(has_text, T.remove_mentions(F.col("text"))).alias("text"),
                       has_text.alias("has_text"), F.col("source").alias("platform"), *keep)


def doc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, raw_label (string or null): the human label of each labelled
    post, at most one row per doc_id. Narrow: 8 bytes of key and a word."""
    labels = read_table(spark, sf_dir, "labels")
    code = label_code(F.col("toxic"), F.col("quality"))
    return labels.select("doc_id", raw_label_text(code, F.col("doc_id")).alias("raw_label"))


_LABEL_ROWS: dict[tuple, int] = {}


def label_rows(spark: SparkSession, sf_dir: str) -> int:
    """Row count of ``labels`` (from Parquet metadata), once per application:
    the size check in front of every broadcast of the label table."""
    key = (spark.sparkContext.applicationId, input_state(spark, sf_dir, "labels"))
    if key not in _LABEL_ROWS:
        _LABEL_ROWS[key] = read_table(spark, sf_dir, "labels").count()
    return _LABEL_ROWS[key]


def with_labels(spark: SparkSession, sf_dir: str, df: DataFrame, how: str = "left") -> DataFrame:
    """``df`` (keyed by doc_id) joined to ``doc_labels``: broadcast when the
    counted label rows are within ``moodline.broadcast.maxRows``, otherwise a
    shuffle join on doc_id."""
    return checked_lookup_join(df, doc_labels(spark, sf_dir), "doc_id", label_rows(spark, sf_dir),
                               how=how)


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents LEFT JOIN labels -> one row per post: the columns of
    ``documents_clean`` plus raw_label.

    ``labels`` has at most one row per doc_id, so the join keeps the row
    count of ``documents``. The cheap ``has_text`` flag is computed before
    the join, so flag-only queries (stage counts, label values, the split)
    prune the text out of it; the clean-up regex runs after the join, so a
    query that keeps labelled posts cleans only those.
    """
    docs = read_keyed(spark, sf_dir, "documents", "doc_id", "doc_id", "text", "source").select(
        "doc_id", F.col("text").alias("original_text"), T.has_content(F.col("text")).alias("has_text"),
        F.col("source").alias("platform"))
    joined = with_labels(spark, sf_dir, docs)
    return joined.select(
        "doc_id", "original_text",
        F.when(F.col("has_text"), T.remove_mentions(F.col("original_text"))).alias("text"),
        "has_text", "platform", "raw_label")
