"""Sharding by minimax contiguous partition (operator 6).

Atomic groups (rows of equal text) are ordered by the 64-bit hash of their
text. The smallest shard capacity for which a greedy fill needs at most
``shards`` shards is found by binary search, and the ordered groups are cut
there. The driver never sees the groups: it works on byte sums of hash
ranges. Ranges that may hold a cut are split 256-fold by further hash bits,
in at most eight small aggregate jobs, until every range in play is a single
group; the capacity is then exact, and all other ranges stay coarse.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moodline.llm.common import written

#: Ranges of the first histogram: the top 12 bits of the hash.
FIRST_BITS = 12
NEXT_BITS = 8
#: Rows of a bucket inside which slots are numbered.
SLOT_ROWS = 50_000


@dataclass(frozen=True)
class Span:
    """Groups that share all but the last ``bits`` bits of their hash, the
    smallest of which is ``start``, with their bytes; ``single``: one group.
    Large groups part a range: ``seg`` of those in its first range lie before."""
    start: int
    bits: int
    size: int
    single: bool
    seg: int = 0


def greedy_cuts(sizes: list[int], shards: int, capacity: int) -> list[int] | None:
    """First index of each further shard when shards are filled in order up to
    ``capacity``; None if that takes more than ``shards`` or an item is larger."""
    cuts, filled = [], 0
    for i, size in enumerate(sizes):
        if size > capacity:
            return None
        if filled + size > capacity:
            cuts.append(i)
            filled = 0
            if len(cuts) >= shards:
                return None
        filled += size
    return cuts


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """Minimax capacity of a contiguous partition of ``sizes``."""
    low, high = max([0, *sizes, -(-sum(sizes) // shards)]), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        if greedy_cuts(sizes, shards, mid) is None:
            low = mid + 1
        else:
            high = mid
    return low


def _reach(spans: list[Span], capacity: int, shards: int) -> list[int]:
    """For each shard, the index of the span in which its greedy fill ends if
    spans of several groups may be cut anywhere, which no real cut surpasses."""
    out, i, left = [], 0, None
    for _ in range(shards):
        room = capacity
        while i < len(spans):
            need = spans[i].size if left is None else left
            if need <= room:
                room, i, left = room - need, i + 1, None
            else:
                if not spans[i].single:
                    left = need - room
                break
        out.append(i)
    return out


def _least_capacity(spans: list[Span], shards: int) -> int:
    """Smallest capacity with which that fill takes all spans; the exact one
    is not smaller."""
    low, high = max([-(-sum(s.size for s in spans) // shards), *(s.size for s in spans if s.single)]), \
        sum(s.size for s in spans)
    while low < high:
        mid = (low + high) // 2
        if _reach(spans, mid, shards)[-1] < len(spans):
            low = mid + 1
        else:
            high = mid
    return low


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """First hash of each shard after the first, and the capacity. ``groups``:
    _u (the order key, a signed 64-bit hash) and _bytes, one row per group."""
    spark = groups.sparkSession
    total = groups.agg(F.sum("_bytes")).first()[0]
    if total is None:
        return [], 0
    first = 64 - FIRST_BITS
    large = groups.filter(F.col("_bytes") > total >> FIRST_BITS).select("_u", "_bytes").collect()
    spans = [Span(r["_u"], 0, r["_bytes"], True) for r in large]
    inside: dict[int, list[int]] = {}
    for r in large:
        inside.setdefault(r["_u"] >> first, []).append(r["_u"])
    rest = groups.withColumn("_seg", F.lit(0))
    if large:
        by_range = spark.createDataFrame(list(inside.items()), "_first long, _large array<long>")
        rest = (groups.withColumn("_first", F.shiftright("_u", first)).join(F.broadcast(by_range), "_first", "left")
                .filter(F.col("_large").isNull() | ~F.array_contains("_large", F.col("_u")))
                .withColumn("_seg", F.coalesce(F.size(F.filter("_large", lambda h: h < F.col("_u"))), F.lit(0))))
        # the size of a null array is -1 or null, by the caller's settings
        rest = rest.withColumn("_seg", F.greatest("_seg", F.lit(0))).select("_u", "_bytes", "_seg")

    def histogram(frame: DataFrame, bits: int) -> list[Span]:
        rows = (frame.groupBy(F.shiftright("_u", bits).alias("_s"), "_seg")
                .agg(F.sum("_bytes").alias("size"), F.count(F.lit(1)).alias("n"), F.min("_u").alias("u")).collect())
        # a single group is its own range of width one
        return [Span(r["u"], 0 if r["n"] == 1 else bits, r["size"], r["n"] == 1, r["_seg"]) for r in rows]

    spans = sorted(spans + histogram(rest, first), key=lambda s: s.start)
    while True:
        # if this fill cuts no span of several groups, it is the groups' own
        # greedy fill, and its capacity is the exact one
        capacity = _least_capacity(spans, shards)
        ends = {i for i in _reach(spans, capacity, shards) if i < len(spans)}
        split = {i for i in ends if not spans[i].single}
        if not split:
            return [spans[i].start for i in greedy_cuts([s.size for s in spans], shards, capacity) or []], capacity
        widest = max(spans[i].bits for i in split)
        wide = {i for i in split if spans[i].bits == widest}
        named = spark.createDataFrame([(spans[i].start >> widest, spans[i].seg) for i in sorted(wide)],
                                      "_s long, _seg int")
        split_rows = rest.withColumn("_s", F.shiftright("_u", widest)).join(F.broadcast(named), ["_s", "_seg"],
                                                                            "left_semi")
        finer = histogram(split_rows, max(0, widest - NEXT_BITS))
        spans = sorted([s for i, s in enumerate(spans) if i not in wide] + finer, key=lambda s: s.start)


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size (UTF-8 bytes of the text plus 1),
    text_crc32, shard, slot (gapless from 0 in each shard).

    Equal texts share a shard. A null text has no bytes and is of the group of
    the empty text. If one group is larger than an even share, its shard holds
    at most that group's bytes more than needed by any partition (the minimax
    optimum for this order). Repeated rows get slots of their own; ties in the
    slot order go by id. With fewer groups than shards some shards are empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = written(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                               F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_u")))
    groups = written(rows.groupBy("_u").agg(F.sum("size").alias("_bytes")))
    cuts, _ = minimax_cuts(groups, shards)
    shard = F.lit(0)
    for c in cuts:
        shard = shard + (F.col("_u") >= F.lit(c)).cast("int")
    placed = rows.withColumn("shard", shard.cast("int"))
    # slots: rows are spread by id over buckets of even size; numbers start at
    # the running count of the buckets before (a table of one row per bucket)
    buckets = max(1, -(-rows.count() // (SLOT_ROWS * shards)))
    buckets = max(buckets, -(-rows.sparkSession.sparkContext.defaultParallelism * 32 // shards))
    placed = placed.withColumn("_b", F.pmod(F.xxhash64("doc_id", "_u"), F.lit(buckets)).cast("int"))
    counts = placed.groupBy("shard", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("shard", "_b", (F.sum("_n").over(
        Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).alias("_before"))
    numbered = placed.withColumn("_i", F.row_number().over(
        Window.partitionBy("shard", "_b").orderBy("doc_id", "_u")))
    out = numbered.join(before, ["shard", "_b"])
    return out.select("doc_id", "size", "text_crc32", "shard",
                      (F.coalesce(F.col("_before"), F.lit(0)) + F.col("_i") - 1).cast("long").alias("slot"))
