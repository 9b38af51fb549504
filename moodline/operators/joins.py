"""Lookup joins whose small side has a checked size.

``broadcast()`` is used only after the small side has been materialised,
counted and (for text keys) weighed. Beyond the bounds the large side's own
frequent keys are found by one partial aggregate over it: keys with more than
1/HOT_SHARE of its rows, so at most HOT_SHARE of them by construction, whether
the small side knows them or not. Their lookup rows are broadcast; the rest
goes through an ordinary shuffle join in which no key has more than that
share. Rows with a null key never reach a shuffle.

This evaluates the large side three times (for the scorer: three tokenization
passes over the text). The alternative, one shuffle join, moves every token
occurrence; on Zipf-like text the frequent keys cover nearly all of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS_CONF = "moodline.broadcast.maxRows"
DEFAULT_BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES_CONF = "moodline.broadcast.maxBytes"
DEFAULT_BROADCAST_BYTES = 512 * 1024 * 1024
#: A key with more than 1/HOT_SHARE of the rows is joined by broadcast.
HOT_SHARE = 10_000


def broadcast_bound(spark) -> int:
    return int(spark.conf.get(BROADCAST_ROWS_CONF, str(DEFAULT_BROADCAST_ROWS)))


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table under the shared checkpoint directory
    and return it read back: lineage is cut, the rows survive executor loss
    (unlike local checkpoints), the plan runs once (an eager ``checkpoint()``
    of an unpersisted plan runs it twice: once to count, once to write), and
    the planner sees the table's real size.
    """
    from moodline.session import scratch_path
    path = scratch_path(df.sparkSession, "tables")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(small: DataFrame, key: str) -> int:
    """Bytes of a text key column (0 for other types)."""
    if dict(small.dtypes)[key] != "string":
        return 0
    return small.agg(F.sum(F.octet_length(key).cast("long"))).first()[0] or 0


def fits_broadcast(small: DataFrame, key: str, small_rows: int, max_rows: int | None = None) -> bool:
    spark = small.sparkSession
    bound = max_rows if max_rows is not None else broadcast_bound(spark)
    limit = int(spark.conf.get(BROADCAST_BYTES_CONF, str(DEFAULT_BROADCAST_BYTES)))
    # rows * 64: a row's fixed part in the hash relation
    return small_rows <= bound and (small_rows * 64 + text_bytes(small, key) <= limit)


def hot_keys(big: DataFrame, key: str, share: int = HOT_SHARE) -> DataFrame:
    """Keys that more than 1/``share`` of the rows with a key have: at most
    ``share`` rows, written once."""
    counts = materialize(big.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    return materialize(counts.filter(F.col("_n") * share > total).select(key))


def checked_lookup_join(big: DataFrame, small: DataFrame, key: str,
                        small_rows: int, max_rows: int | None = None, how: str = "inner") -> DataFrame:
    """Inner or left join of a large stream of keys with a keyed lookup table.

    ``small`` must be unique on ``key``, already materialised, with
    ``small_rows`` rows (counted by the caller).
    """
    assert how in ("inner", "left")
    if fits_broadcast(small, key, small_rows, max_rows):
        return big.join(F.broadcast(small), key, how)
    hot = hot_keys(big, key)
    # at most HOT_SHARE rows each: the known ones with their lookup values
    known = materialize(small.join(F.broadcast(hot), key, "left_semi"))
    present = big.filter(F.col(key).isNotNull())
    parts = [present.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(known), key, how),
             present.join(F.broadcast(hot), key, "left_anti").join(small, key, how)]
    if how == "left":
        nothing = [F.lit(None).cast(t).alias(c) for c, t in small.dtypes if c != key]
        parts.append(big.filter(F.col(key).isNull()).select(key, *[c for c in big.columns if c != key], *nothing))
    return reduce(DataFrame.unionByName, parts)


def counted_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``checked_lookup_join`` for a narrow, written ``small`` table (unique on
    ``key``) whose size is not known yet: it is counted first (a scan of a
    written table), then broadcast within the bound or shuffle-joined."""
    return checked_lookup_join(big, small, key, small.count(), how=how)
