"""Source divergence audit (operator 11): sparse merges of sorted counts.

Term counts of every (language, source) group are made where the text is read
and summed by one shuffle on (language, term); there a term's document count
decides whether it is kept. The kept terms are numbered inside hash buckets of
bounded size, so a group is one sorted (term id, count) array for each bucket.
A task co-groups the arrays of a block of sources with those of another block
and merges every unordered pair: a galloping intersection finds the common
terms, what only one side has is priced against the other's probability of an
unseen term, and terms absent on both sides are one product. Bucket sums of a
pair are added by Spark. All arithmetic is in whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodline.llm.common import written
from moodline.operators.joins import broadcast_bound

SCALE = 1_000_000_000
MIN_DOCS = 10
TOP_TERMS = 10
#: Expected number of kept terms of a language in a bucket.
BUCKET_TERMS = 4096
#: Sources of a block; a task merges a block with itself or with another one.
SOURCE_BLOCK = 32
#: Groups that a task counts at a time hold at most so many different terms.
TASK_TERMS = 400_000
#: Longer texts are counted in pieces cut at a separator.
PIECE_BYTES = 1 << 20
GALLOP = 256
#: Copies of a group's totals when they are joined by a shuffle.
SALTS = 64

#: A-Z lower-cased; all ASCII that is no letter separates; bytes of non-ASCII
#: characters stay.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, at most about PIECE_BYTES of it at a time."""
    text, at = text.translate(_TERM_BYTES), 0
    while at < len(text):
        cut = text.find(b" ", at + PIECE_BYTES)
        end = len(text) if cut < 0 else cut
        yield text[at:end].split()
        at = end


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with the term) of
    (lang, source, text) rows; a task may give several rows for a term."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()),
                        ("n", pa.int64()), ("docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, tuple[Counter, Counter]] = {}

        def drained() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, in_docs) in groups.items():
                terms = list(n)
                yield pa.RecordBatch.from_arrays([
                    pa.repeat(lang, len(terms)), pa.repeat(source, len(terms)),
                    pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()),
                    pa.array([in_docs[t] for t in terms], pa.int64())], schema=schema)
            groups.clear()

        for batch in batches:
            size = 0
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                          batch.column(2).cast(pa.binary()), strict=True):
                n, in_docs = groups.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                whole = text.as_py()
                if len(whole) <= PIECE_BYTES:
                    words = whole.translate(_TERM_BYTES).split()
                    n.update(words)
                    in_docs.update(set(words))
                else:
                    seen: set = set()
                    for words in pieces(whole):
                        n.update(words)
                        seen.update(words)
                    in_docs.update(seen)
                size += len(n) - before
                if size > TASK_TERMS // 8:
                    size = 0
                    if sum(len(g[0]) for g in groups.values()) > TASK_TERMS:
                        yield from drained()
        yield from drained()

    return docs.select("lang", "source", "text").mapInArrow(
        run, "lang string, source string, term string, n long, docs long")


def kept_terms(docs: DataFrame, min_docs: int) -> DataFrame:
    """lang, term, source, n, lang_n, first: counts of the terms that at least
    ``min_docs`` documents of the language have. ``first`` marks one row of a
    (lang, term). Written once."""
    w = Window.partitionBy("lang", "term")
    counts = (count_terms(docs).repartition("lang", "term").groupBy("lang", "term", "source")
              .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    return written(counts.select(
        "lang", "term", "source", "n", F.sum("n").over(w).alias("lang_n"), F.sum("docs").over(w).alias("_docs"),
        (F.row_number().over(w.orderBy("source")) == 1).alias("first")).filter(F.col("_docs") >= min_docs).drop("_docs"))


def group_totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, pos (from 0 in the language), total and lang_total (kept
    occurrences), terms (kept terms of the language): a row for every group
    that occurs. Written once."""
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    whole = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("first").alias("terms"))
    zero = F.lit(0).cast("long")
    pos = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    return written(docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left")
                   .join(whole, "lang", "left").select(
        "lang", "source", pos.alias("pos"), F.coalesce("total", zero).alias("total"),
        F.coalesce("lang_total", zero).alias("lang_total"), F.coalesce("terms", zero).alias("terms")))


def price(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (count + 2) / (total + 2 terms)); exact for any count."""
    scaled = (count + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", scaled, (total + 2 * terms).cast("decimal(20,0)")) + 1


def prices(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    size = total + 2 * terms
    if len(counts) and int(counts.max()) >= (1 << 63) // SCALE - 2:
        return np.array([1 + SCALE * (c + 2) // size for c in counts.tolist()], np.int64)
    return 1 + SCALE * (counts.astype(np.int64) + 2) // size


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); p and q are at most SCALE + 1."""
    d = p - q
    return d * d // (p + q)


def intersect(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b`` of the values that both rising arrays have:
    for each run of the shorter one the bracket in the longer one is found by
    doubling steps from where the run before ended, then by bisection inside."""
    if len(a) > len(b):
        j, i = intersect(b, a)
        return i, j
    found_a, found_b, at = [], [], 0
    for start in range(0, len(a), GALLOP):
        run = a[start:start + GALLOP]
        step = GALLOP
        while at + step < len(b) and b[at + step] < run[-1]:
            step *= 2
        inside = b[at:at + step + 1]
        place = np.searchsorted(inside, run)
        hit = np.flatnonzero((place < len(inside)) & (inside[np.minimum(place, len(inside) - 1)] == run))
        found_a.append(hit + start)
        found_b.append(place[hit] + at)
        at += int(place[-1])
        if at >= len(b):
            break
    none = np.empty(0, np.int64)
    return (np.concatenate(found_a) if found_a else none), (np.concatenate(found_b) if found_b else none)


class Side:
    """A group's part of a bucket: term ids, prices, price of an unseen term."""

    def __init__(self, source: str, ids: np.ndarray, counts: np.ndarray, total: int, terms: int) -> None:
        self.source, self.ids = source, ids
        self.p = prices(counts, total, terms)
        self.unseen = int(prices(np.zeros(1, np.int64), total, terms)[0])
        self.all = None

    def against(self, unseen: int) -> np.ndarray:
        return gap(self.p, np.int64(unseen))


def merge(a: Side, b: Side, terms: int) -> int:
    """Sum of the gaps of a bucket of ``terms`` kept terms."""
    i, j = intersect(a.ids, b.ids)
    only_a, only_b = a.against(b.unseen), b.against(a.unseen)
    absent = terms - len(a.ids) - len(b.ids) + len(i)
    return (int(gap(a.p[i], b.p[j]).sum())
            + int(only_a.sum()) - int(only_a[i].sum()) + int(only_b.sum()) - int(only_b[j].sum())
            + absent * int(gap(np.int64(a.unseen), np.int64(b.unseen))))


def bucket_arrays(kept: DataFrame, buckets: int) -> DataFrame:
    """lang, bucket, source, ids, counts: the sorted array of each group in
    each bucket that it has terms of, and size, the bucket's kept terms."""
    placed = kept.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    w = Window.partitionBy("lang", "bucket")
    numbered = placed.select("lang", "bucket", "source", "n",
                             (F.dense_rank().over(w.orderBy("term")) - 1).alias("id"))
    arrays = numbered.groupBy("lang", "bucket", "source").agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("_a"))
    return arrays.select("lang", "bucket", "source", F.col("_a.id").alias("ids"), F.col("_a.n").alias("counts"),
                         F.max(F.element_at("_a.id", -1) + 1).over(w).alias("size"))


def pair_values(kept: DataFrame, groups: DataFrame, block: int = SOURCE_BLOCK,
                bucket_terms: int = BUCKET_TERMS) -> DataFrame:
    """lang, a, b, value of every unordered pair of sources of a language."""
    most_terms = groups.agg(F.max("terms")).first()[0] or 0
    buckets = max(1, -(-most_terms // bucket_terms))
    arrays = written(bucket_arrays(kept, buckets))
    sizes = arrays.groupBy("lang", "bucket").agg(F.first("size").alias("size"))
    # every group stands in every bucket, also where it has no term
    blocks = F.floor((F.max("pos").over(Window.partitionBy("lang"))) / block).cast("int")
    placed = groups.select("lang", "source", "total", "terms", F.floor(F.col("pos") / block).cast("int").alias("own"),
                           blocks.alias("last"))
    grid = placed.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    full = grid.join(arrays.drop("size"), ["lang", "bucket", "source"], "left").join(sizes, ["lang", "bucket"], "left")
    cells = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last")))).select(
        "lang", "bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own",
        "source", "total", "terms", F.coalesce("size", F.lit(0)).cast("long").alias("size"), "ids", "counts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        cell, low, high = None, [], []

        def drained() -> pa.RecordBatch:
            keys = list(sums)
            out = pa.RecordBatch.from_arrays(
                [pa.array([k[i] for k in keys], pa.string()) for i in range(3)]
                + [pa.array([sums[k] for k in keys], pa.int64())], ["lang", "a", "b", "value"])
            sums.clear()
            return out

        def close() -> None:
            lang, size = cell[0], cell[4]
            same = cell[2] == cell[3]
            for x, a in enumerate(low):
                for b in (low[x + 1:] if same else high):
                    key = (lang, a.source, b.source)
                    sums[key] += merge(a, b, size) if size else 0

        for batch in batches:
            ids, counts = batch.column("ids"), batch.column("counts")
            rows = batch.drop_columns(["ids", "counts"]).to_pylist()
            for i, r in enumerate(rows):
                key = (r["lang"], r["bucket"], r["low"], r["high"], r["size"])
                if key != cell:
                    if cell is not None:
                        close()
                        if len(sums) > TASK_TERMS:
                            yield drained()
                    cell, low, high = key, [], []
                none = np.empty(0, np.int64)
                side = Side(r["source"], ids[i].values.to_numpy() if ids[i].is_valid else none,
                            counts[i].values.to_numpy() if counts[i].is_valid else none, r["total"], max(r["terms"], 1))
                (low if r["own"] == r["low"] else high).append(side)
        if cell is not None:
            close()
        yield drained()

    keys = ["lang", "bucket", "low", "high"]
    return (cells.repartition(*keys).sortWithinPartitions(*keys, "own", "source").mapInArrow(
        run, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))


def with_totals(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """Kept rows with their group's totals: a broadcast join if the counted
    groups are within the bound, else a salted shuffle join."""
    totals = groups.select("lang", "source", "total", "lang_total", "terms")
    if totals.count() <= min(broadcast_bound(kept.sparkSession), 100_000):
        return kept.join(F.broadcast(totals), ["lang", "source"])
    salted = totals.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return kept.withColumn("_salt", F.pmod(F.hash("term"), F.lit(SALTS))).join(salted, ["lang", "source", "_salt"])


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, block: int = SOURCE_BLOCK,
          bucket_terms: int = BUCKET_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank. Part ``pair``: how far a source's
    term distribution is from that of each other source of its language
    (smoothed, whole-number chi-square distance). Part ``term``: the ``top``
    terms that a source has more often than its language.

    A null text, language or source counts as ''. A group without terms has
    its pairs; a language of one source has none, and one without kept terms
    has pairs of value 0. Ties are ranked by the item's UTF-8 bytes, from 1.
    Repeated rows count each. Long texts are counted in pieces of about 1 MB.
    An empty table gives no row; other columns are not read, whatever their
    names."""
    empty = F.lit("")
    rows = docs.select(*[F.coalesce(F.col(c), empty).alias(c) for c in ("lang", "source", "text")])
    kept = kept_terms(rows, min_docs)
    groups = group_totals(rows, kept)

    one_way = pair_values(kept, groups, block, bucket_terms)
    both = one_way.select("lang", F.explode(F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
        F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("_p"), "value").select(
        "lang", "_p.source", F.lit("pair").alias("part"), "_p.item", "value")

    p, q = F.col("p"), F.col("q")
    term = (with_totals(kept, groups)
            .select("lang", "source", "term", price(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
                    price(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"))
            .filter(p > q)
            .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                    F.call_function("div", (p - q) * (p - q), p + q).alias("value")))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return (both.withColumn("rank", rank)
            .unionByName(term.withColumn("rank", rank).filter(F.col("rank") <= top)))
