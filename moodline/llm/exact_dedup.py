"""Exact dedup by progressive refinement (operator 9).

Rows are grouped by text length, then by a hash of the first characters, then
by a full hash; each level reads more of the text, and only for rows whose
group of the level before has another member. Groups are counted with partial
aggregates, so a text copied into a third of all rows is one row per task.
The text itself never moves: a level hands the next scan the *slots* of its
surviving groups, a set of at most ``SLOTS`` integers (bounded by
construction, hence broadcast). A slot shared with another group lets a few
rows through that the next level separates again, so results stay exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodline.llm.common import ascii_lower, written

#: Size of the survivor filter handed from level to level.
SLOTS = 1 << 20
PREFIX_CHARS = 256


def _slot(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(SLOTS))


def _surviving_slots(rows: DataFrame, *keys: str) -> DataFrame:
    """Slots of the groups of ``keys`` with two or more rows."""
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return groups.select(_slot(*keys).alias("_slot")).distinct()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, and the
    ``carry`` columns (functions of the normalised text, over ``docs``).

    Texts are equal when identical after lower-casing A-Z; a null text counts
    as empty, and empty texts form one group. The row with the largest id
    stays; of repeated rows (same id, equal text) one stays; a null id stays
    only if its group has no other id. Further columns are ignored. An empty
    table gives an empty result.
    """
    extra = carry or {}
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"),
                       *[c.alias(k) for k, c in extra.items()])
    base = base.withColumn("_len", F.octet_length("_t"))
    by_length = _surviving_slots(base.select("_len"), "_len")
    # level 2: the prefix is hashed only where the length is shared
    prefix = F.xxhash64(ascii_lower(F.substring(F.col("_t"), 1, PREFIX_CHARS)))
    level2 = (base.withColumn("_slot", _slot("_len")).join(F.broadcast(by_length), "_slot")
              .withColumn("_head", prefix))
    by_head = _surviving_slots(level2.select("_len", "_head"), "_len", "_head")
    # level 3: the full hash only where length and prefix are shared
    full = F.sha2(ascii_lower(F.col("_t")), 256)
    level3 = (base.withColumn("_head", prefix).withColumn("_slot", _slot("_len", "_head"))
              .join(F.broadcast(by_head.withColumn("_hit", F.lit(True))), "_slot", "left"))
    rows = written(level3.select("doc_id", "_len", "_head",
                                 F.when(F.col("_hit"), full).alias("_full"), *extra))
    alone = rows.filter(F.col("_full").isNull()).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), *extra)
    # repeated rows collapse to a count first, so that one of them can stay
    key = ["_len", "_head", "_full"]
    shared = (rows.filter(F.col("_full").isNotNull())
              .groupBy("doc_id", *key, *extra).agg(F.count(F.lit(1)).alias("_n")))
    groups = written(rows.filter(F.col("_full").isNotNull()).groupBy(*key)
              .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    joined = (shared.join(groups, key)
              .withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))))
    joined = joined.select("doc_id", "keep_id", "group_size",
                           (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_i") == 1)).alias("kept"),
                           *extra)
    return alone.unionByName(joined)
