"""Deterministic ordering, exact stratified split, global index and batches
(E3-E5).

A row's place in any order is ``md5('<seed>:' || key)`` then the key itself:
independent of partitioning and identical in every engine.

Neither the split nor the index runs a window over a whole class or over the
whole table. Rows are bucketed by the first ``BUCKET_HEX`` hex digits of their
order key (uniform, 65,536 buckets); only the small table of per-bucket counts
gets running sums, and only rows of the few buckets that straddle a cut are
ranked individually.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

BUCKET_HEX = 4
SPLIT_SEED = "42"
SHUFFLE_SEED = "shuffle-1"
BATCH_SIZE = 32


def order_key(key: Column, seed: str = SPLIT_SEED) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), key.cast("string")))


def _bucket(okey: Column) -> Column:
    return F.conv(F.substring(okey, 1, BUCKET_HEX), 16, 10).cast("int")


def class_quotas(df: DataFrame, label: str, test_fraction: float) -> DataFrame:
    """Per class test quota: total ceil(f*n), largest remainder, ties to the
    lower class. Input is aggregated to one row per class before the window,
    so the window sees (number of classes) rows."""
    return quotas_of_counts(df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class")), label, test_fraction)


def quotas_of_counts(counts: DataFrame, label: str, test_fraction: float) -> DataFrame:
    """``class_quotas`` from one row (label, n_class) per class, in whole
    numbers throughout: products of two row counts are decimals of 38 digits."""
    every = Window.partitionBy(F.lit(0))
    # f is given with at most 6 decimals
    scale = 1_000_000
    f_num = int(round(test_fraction * scale))
    q = counts.select(label, "n_class", F.sum("n_class").over(every).alias("n_all"))
    q = q.withColumn("t_all", F.expr(
        f"(cast(n_all as decimal(19,0)) * {f_num} + {scale - 1}) div cast({scale} as decimal(19,0))"))
    product = "cast(n_class as decimal(19,0)) * cast(t_all as decimal(19,0))"
    q = q.select("*", F.expr(f"({product}) div cast(n_all as decimal(19,0))").alias("q_floor"),
                 F.expr(f"({product}) % cast(n_all as decimal(19,0))").alias("rem"))
    left_over = (F.col("t_all") - F.sum("q_floor").over(every))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("rem"), F.asc(label)))
    return q.select(label, "n_class",
                    (F.col("q_floor") + F.when(rank <= left_over, 1).otherwise(0)).cast("long").alias("quota"))


def stratified_split(df: DataFrame, key: str, label: str, test_fraction: float = 0.2,
                     seed: str = SPLIT_SEED) -> DataFrame:
    """Adds ``split`` ('test' / 'train'): exactly the class quotas of
    ``class_quotas`` go to test, chosen as the first rows of each class in
    order-key order. Rows with a null label are left out."""
    base = (df.filter(F.col(label).isNotNull())
            .withColumn("_okey", order_key(F.col(key), seed))
            .withColumn("_bucket", _bucket(F.col("_okey"))))
    quotas = class_quotas(base, label, test_fraction)
    per_bucket = base.groupBy(label, "_bucket").agg(F.count(F.lit(1)).alias("_nb"))
    w = Window.partitionBy(label).orderBy("_bucket")
    running = per_bucket.select(label, "_bucket", "_nb",
                                (F.sum("_nb").over(w) - F.col("_nb")).alias("_before"))
    cuts = (running.join(F.broadcast(quotas.select(label, "quota")), label)
            .filter((F.col("_before") < F.col("quota"))
                    & (F.col("quota") <= F.col("_before") + F.col("_nb")))
            .select(label, F.col("_bucket").alias("_cut"),
                    (F.col("quota") - F.col("_before")).alias("_need")))
    # one row per class with a non-zero quota: a proven, tiny broadcast
    tagged = base.join(F.broadcast(cuts), label, "left")
    plain = (tagged.filter(F.col("_cut").isNull() | (F.col("_bucket") != F.col("_cut")))
             .withColumn("split", F.when(F.col("_bucket") < F.col("_cut"), "test").otherwise("train")))
    w_cut = Window.partitionBy(label).orderBy("_okey", key)
    edge = (tagged.filter(F.col("_bucket") == F.col("_cut"))
            .withColumn("split", F.when(F.row_number().over(w_cut) <= F.col("_need"), "test")
                        .otherwise("train")))
    cols = [c for c in df.columns] + ["split"]
    return plain.select(*cols).unionByName(edge.select(*cols))


def global_index(df: DataFrame, key: str, seed: str = SHUFFLE_SEED) -> DataFrame:
    """Adds ``idx`` (0-based position of the row in order-key order).

    Offsets come from running sums over the per-bucket count table (at most
    16^BUCKET_HEX rows, the only un-partitioned window); rows are then ranked
    inside their own bucket, which is ~1/65536 of the data.
    """
    base = (df.withColumn("_okey", order_key(F.col(key), seed))
            .withColumn("_bucket", _bucket(F.col("_okey"))))
    counts = base.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_nb"))
    offsets = counts.select("_bucket", (F.sum("_nb").over(Window.orderBy("_bucket")) - F.col("_nb"))
                            .alias("_offset"))
    w = Window.partitionBy("_bucket").orderBy("_okey", key)
    # offsets has at most 65,536 rows: broadcast is bounded by construction
    ranked = base.join(F.broadcast(offsets), "_bucket")
    return (ranked.withColumn("idx", F.col("_offset") + F.row_number().over(w) - 1)
            .drop("_okey", "_bucket", "_offset"))


def with_batches(df: DataFrame, key: str, batch_size: int = BATCH_SIZE,
                 seed: str = SHUFFLE_SEED) -> DataFrame:
    """Batches of ``batch_size`` consecutive rows of the shuffled order; the
    last one may be partial."""
    return global_index(df, key, seed).withColumn("batch_id", F.floor(F.col("idx") / batch_size))


EPOCH_ROUNDS = 6
#: Steps of the walk back into the range; see ``epoch_place``.
WALK_STEPS = 64


def epoch_domain(n: int) -> tuple[int, int]:
    """(a, b), nearly equal, with a b >= n and a b - n < a."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def epoch_place(idx: Column, n: int, epoch: Column | int, seed: str = SHUFFLE_SEED) -> Column:
    """Place (0 .. n - 1) of row number ``idx`` (0 .. n - 1) in the order of an
    epoch: a bijection for every epoch, computed from the row number alone, so
    that a new order needs no sort, window or shuffle.

    A Feistel network over pairs (l, r) of numbers below (a, b), a b >= n: in
    turn l and r get a keyed hash of the other one added. A result of n or more
    is put through the network again until it is below n (cycle walking). Fewer
    than a numbers lie outside, so a walk has fewer than a steps; beyond
    WALK_STEPS = 64 steps its chance is (1 / a)^64, with a > 64."""
    a, b = epoch_domain(n)
    lead = F.concat(F.lit(f"{seed}:"), (F.lit(epoch) if isinstance(epoch, int) else epoch).cast("string"))

    def keyed(i: Column, half: Column) -> Column:
        digest = F.md5(F.concat(lead, F.lit(":"), i.cast("string"), F.lit(":"), half.cast("string")))
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")

    def network(x: Column) -> Column:
        halves = F.struct(F.call_function("div", x, F.lit(b)).alias("l"), (x % b).alias("r"))
        out = F.aggregate(
            F.sequence(F.lit(0), F.lit(EPOCH_ROUNDS - 1)), halves,
            lambda s, i: F.when(i % 2 == 0, F.struct(((s["l"] + keyed(i, s["r"]) % a) % a).alias("l"), s["r"].alias("r")))
            .otherwise(F.struct(s["l"].alias("l"), ((s["r"] + keyed(i, s["l"]) % b) % b).alias("r"))))
        return F.transform(F.array(out), lambda s: s["l"] * b + s["r"])[0]

    walk = F.sequence(F.lit(1), F.lit(min(a, WALK_STEPS)))
    return F.aggregate(walk, F.lit(-1).cast("long"),
                       lambda x, i: F.when(x.between(0, n - 1), x).otherwise(network(F.when(i == 1, idx).otherwise(x))))


def with_epoch_batches(df: DataFrame, key: str, epochs: int, batch_size: int = BATCH_SIZE, seed: str = SHUFFLE_SEED,
                       n: int | None = None) -> DataFrame:
    """A row for each row and epoch (1 ..): adds epoch, place, batch_id.
    The row numbers are made once (``global_index``); every epoch's order is an
    expression of them."""
    n = df.count() if n is None else n
    numbered = global_index(df, key, seed).withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    placed = numbered.withColumn("place", epoch_place(F.col("idx").cast("long"), n, F.col("epoch"), seed))
    return placed.withColumn("batch_id", F.floor(F.col("place") / batch_size)).drop("idx")


RANGE_BUCKETS = 65536


def key_cut(df: DataFrame, key: str, n: int, max_rows: int | None = None):
    """A literal c (of the key's type) for an integral or integral-decimal
    ``key`` such that at least n rows (or all rows) have a non-null key <= c,
    and at most n + max_rows do when keys are unique (None for no keys).

    The key range is cut into RANGE_BUCKETS equal ranges, counted per range
    (a partial aggregate), and a running sum over the range counts finds
    the range holding the n-th key. While that range holds more than
    ``max_rows`` rows it is cut again (at most four rounds for 64-bit keys).
    Offsets are decimals, so no key range can overflow under ANSI mode.
    """
    from moodline.operators.joins import broadcast_bound
    bound = max_rows if max_rows is not None else broadcast_bound(df.sparkSession)
    keyed = df.filter(F.col(key).isNotNull())
    lit = _key_literal(df, key)
    lo, hi = keyed.agg(F.min(key), F.max(key)).first()
    if lo is None:
        return None
    lo, hi = int(lo), int(hi)      # integral keys: exact Python ints
    need = n
    upper = hi
    while need > 0:
        width = -(-(hi - lo + 1) // RANGE_BUCKETS)
        dec = lambda v: F.lit(Decimal(v)).cast("decimal(38,0)")
        offset = F.col(key).cast("decimal(38,0)") - dec(lo)
        bucket = F.floor(offset / dec(width)).cast("long")
        counts = (keyed.filter(F.col(key).between(lit(lo), lit(hi)))
                  .groupBy(bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n")))
        running = counts.select("_b", "_n", F.sum("_n").over(Window.orderBy("_b")).alias("_cum"))
        hit = running.filter(F.col("_cum") >= need).orderBy("_b").select("_b", "_n", "_cum").first()
        if hit is None:            # fewer than n keys in [lo, hi]: take them all
            upper = hi
            break
        b, n_b, cum = hit["_b"], hit["_n"], hit["_cum"]
        upper = min(hi, lo + (b + 1) * width - 1)
        if n_b <= bound or width == 1:
            break
        need -= cum - n_b          # keys below the cut range are taken
        lo, hi = lo + b * width, upper
    return lit(upper)


def _key_literal(df: DataFrame, key: str):
    """A literal maker of the key's own type (so that filters on an integral
    key still reach the Parquet scan; decimals hold any 64-bit value)."""
    dtype = df.schema[key].dataType
    if isinstance(dtype, Ty.DecimalType):
        return lambda v: F.lit(Decimal(v)).cast(dtype)
    return lambda v: F.lit(int(v)).cast(dtype)


def first_n(df: DataFrame, key: str, n: int, max_rows: int | None = None) -> DataFrame:
    """The n rows with the smallest values of a unique integral ``key`` (rows
    with a null key are not ordered), in key order.

    ``orderBy(key).limit(n)`` merges n rows of every input partition in one
    task. Here ``key_cut`` finds the cut from range counts, the filter
    ``key <= cut`` is pushed to the scan, and only the at most n + max_rows
    rows below it are sorted.
    """
    upper = key_cut(df, key, n, max_rows)
    keyed = df.filter(F.col(key).isNotNull())
    if upper is None:
        return keyed.limit(0)
    return keyed.filter(F.col(key) <= upper).orderBy(key).limit(n)
