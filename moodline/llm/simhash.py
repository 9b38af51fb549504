"""SimHash near-dedup with bit-sliced comparison (operator 1).

1. Each text becomes a 64-bit fingerprint where it is read (hashes of word
   shingles, majority per bit).
2. Equal fingerprints are one node (partial aggregate), so copies never meet.
3. Candidates: the 64 bits are cut into ``max_bits + 2`` blocks. Two
   fingerprints within ``max_bits`` agree on at least two blocks, so each one
   goes to a bucket for every pair of blocks (about 21 key bits for radius 4).
   A bucket over ``HOT_ROWS`` is split by ``max_bits + 1`` pieces of its other
   bits, of which one must agree as well, again and again until all are small:
   an exact split, no row is lost.
4. Buckets are compared bit-sliced: bit plane b holds bit b of all rows of a
   sorted run; XOR with the plane shifted by s rows compares each row with its
   s-th successor, 64 per word. Carry-save counters add the planes, and words
   whose lanes all exceed the radius are abandoned.
5. A bucket emits only the links of a spanning forest, never all pairs.
   Components are found by star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodline.llm.common import map_rows, row_hash, written
from moodline.llm.components import component_roots
from moodline.operators.joins import checked_lookup_join

BITS = 64
SEED = 42
#: Rows above which a bucket is split by further bits.
HOT_ROWS = 4096
#: Rows compared in one go; whole buckets only.
CHUNK_ROWS = 1 << 15
#: Shingles whose bits are counted at a time.
COUNT_ROWS = 1 << 15


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Signed 64-bit SimHash of the word shingles of ``text`` (0 without words)."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = iter([b" ".join(words)])
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), COUNT_ROWS):
        part = hashes[at:at + COUNT_ROWS]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_hash, fp (signed 64-bit), one row per input row."""
    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                                row_hash(F.col(text_col)).alias("row_hash")),
                    lambda c: c | {"fp": [fingerprint(t, shingle) for t in c["text"]]},
                    "doc_id long, row_hash long, fp long")


def bit_planes(values: np.ndarray) -> np.ndarray:
    """(64, words + 1) uint64: word w of plane b holds bit b of values 64w..64w+63."""
    words = -(-len(values) // BITS) + 1
    padded = np.zeros(words * BITS, np.uint64)
    padded[:len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def near_lanes(planes: np.ndarray, lanes: np.ndarray, words: np.ndarray, shift: int, radius: int) -> tuple:
    """Which of the ``lanes`` (bit i of a word: row i, compared with row
    i + shift) differ in at most ``radius`` bits; (words, their lanes)."""
    skip, r = divmod(shift, BITS)
    last = planes.shape[1] - 1
    count = [np.zeros(len(words), np.uint64) for _ in range(radius.bit_length())]
    over = np.zeros(len(words), np.uint64)

    def differ(b: int) -> np.ndarray:
        plane = planes[b]
        other = plane[np.minimum(words + skip, last)]
        if r:
            other = (other >> np.uint64(r)) | (plane[np.minimum(words + skip + 1, last)] << np.uint64(BITS - r))
        return plane[words] ^ other

    for b in range(0, BITS, 2):
        x, y = differ(b), differ(b + 1)
        # carry-save: two planes and the ones counter make a sum and a carry
        half = x ^ y
        carry = (x & y) | (half & count[0])
        count[0] ^= half
        for k in range(1, len(count)):
            count[k], carry = count[k] ^ carry, count[k] & carry
        over |= carry
        if b % 8 == 6:
            above, same = over, ~over
            for k in range(len(count) - 1, -1, -1):
                if radius >> k & 1:
                    same = same & count[k]
                else:
                    above, same = above | (same & count[k]), same & ~count[k]
            lanes = lanes & ~above
            live = lanes != 0
            if not live.all():  # abandon words without a lane left
                words, lanes, over = words[live], lanes[live], over[live]
                count = [c[live] for c in count]
            if not len(words):
                break
    return words, lanes


def bucket_links(keys: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links inside each bucket; rows sorted by key."""
    n = len(keys)
    planes = bit_planes(values)
    words = np.arange(planes.shape[1] - 1)
    parent = np.arange(n)
    left, right = [], []
    shift = 1
    while shift < n:
        same = np.zeros((planes.shape[1] - 1) * BITS, np.uint8)
        same[:n - shift] = keys[shift:] == keys[:-shift]
        lanes = np.packbits(same, bitorder="little").view(np.uint64)
        words = words[lanes[words] != 0]  # a run shorter than the shift is done
        if not len(words):
            break
        at, hit = near_lanes(planes, lanes[words], words, shift, radius)
        if len(at):
            lane = np.unpackbits(hit.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            w, i = np.nonzero(lane)
            a = at[w] * BITS + i
            fresh = parent[a] != parent[a + shift]
            if fresh.any():
                for p in a[fresh]:
                    x, y = int(parent[p]), int(parent[p + shift])
                    while parent[x] != x:
                        x = int(parent[x])
                    while parent[y] != y:
                        y = int(parent[y])
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                        left.append(p)
                        right.append(p + shift)
                while True:  # every row points at its root again
                    up = parent[parent]
                    if (up == parent).all():
                        break
                    parent = up
        shift += 1
    return values[np.array(left, np.int64)], values[np.array(right, np.int64)]


def _links_of_partition(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = np.empty(0, np.int64), np.empty(0, np.uint64)

        def emit(k: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
            a, b = bucket_links(k, v, radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            values = np.concatenate([values, batch.column(1).to_numpy().view(np.uint64)])
            if len(keys) >= CHUNK_ROWS:  # all but the last, maybe unfinished bucket
                end = int(np.searchsorted(keys, keys[-1]))
                if end:
                    yield from emit(keys[:end], values[:end])
                    keys, values = keys[end:], values[end:]
        yield from emit(keys, values)
    return run


def _pieces(bits: list[int], parts: int) -> list[list[int]]:
    """``bits`` cut into ``parts`` runs of even length."""
    edge = [len(bits) * i // parts for i in range(parts + 1)]
    return [bits[edge[i]:edge[i + 1]] for i in range(parts)]


def _masked(fp: Column, bits: list[int]) -> Column:
    mask = sum(1 << b for b in bits)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def links(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """a, b: links that connect all distinct fingerprints (fp) reachable from
    each other over at most ``max_bits`` differing bits."""
    blocks = _pieces(list(range(BITS)), max_bits + 2)
    tables = list(combinations(range(len(blocks)), 2))
    fp = F.col("fp")
    cells = F.array(*[F.struct(F.xxhash64(F.lit(t), _masked(fp, blocks[i] + blocks[j])).alias("key"),
                               F.lit(_signed(blocks[i] + blocks[j])).alias("used")) for t, (i, j) in enumerate(tables)])
    rows = fps.select("fp", F.explode(cells).alias("_c")).select("_c.key", "fp", "_c.used")
    parts = small_buckets(rows, max_bits)
    spread = reduce(DataFrame.unionByName, parts).repartition("key").sortWithinPartitions("key")
    return spread.mapInArrow(_links_of_partition(max_bits), "a long, b long")


def _signed(bits: list[int]) -> int:
    mask = sum(1 << b for b in bits)
    return mask - (1 << 64) if mask >> 63 else mask


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads close ones."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def split_buckets(rows: DataFrame, max_bits: int) -> DataFrame:
    """(key, fp, used) rows of large buckets in finer ones: the bits that their
    key has not used are cut into ``max_bits`` + 1 pieces, and two rows within
    ``max_bits`` bits agree in one of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, fp, used = (batch.column(i).to_numpy().view(np.uint64) for i in range(3))
            for u in np.unique(used):
                own = used == u
                free = [b for b in range(BITS) if not int(u) >> b & 1]
                for p, piece in enumerate(_pieces(free, max_bits + 1)):
                    mask = np.uint64(sum(1 << b for b in piece))
                    new = _mix(_mix(key[own] + np.uint64(p + 1)) ^ (fp[own] & mask))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x.view(np.int64)) for x in (new, fp[own], np.full(len(new), u | mask))], ["key", "fp", "used"])

    return rows.mapInArrow(run, "key long, fp long, used long")


def small_buckets(rows: DataFrame, max_bits: int) -> list[DataFrame]:
    """(key, fp) rows in buckets of at most HOT_ROWS: larger ones are split
    again and again. It comes to an end: with r bits unused a bucket has at
    most 2^r different fingerprints, and each split uses a fifth of them."""
    parts = []
    while True:
        hot = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.first("used").alias("_u"))
                      .filter((F.col("_n") > HOT_ROWS) & (F.bit_count("_u") < BITS - max_bits))
                      .select("key", F.lit(True).alias("_hot")))
        n_hot = hot.count()
        if not n_hot:
            return [*parts, rows.select("key", "fp")]
        marked = checked_lookup_join(rows, hot, "key", n_hot, how="left")
        parts.append(marked.filter(F.col("_hot").isNull()).select("key", "fp"))
        rows = written(split_buckets(marked.filter(F.col("_hot")).select("key", "fp", "used"), max_bits))


def near_dedup(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, row_hash, fp, component_id (the smallest id
    reachable over links of at most ``max_bits`` differing bits).

    Null, empty and word-free texts have fingerprint zero and are linked like
    any other; of a very long text every shingle counts. A fingerprint bit set
    in exactly half the shingles is 0. Ids of null are ignored by the minimum
    (component_id is null if a component has no other); repeated rows each give
    a row. Other columns are not read, whatever their names; an empty table
    gives an empty result.
    """
    rows = written(fingerprints(docs, shingle, id_col, text_col))
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("_id")))
    roots = component_roots(links(nodes.select("fp"), max_bits))
    placed = (nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
              .select("fp", "_id", F.coalesce("root", "fp").alias("root")))
    least = placed.groupBy("root").agg(F.min("_id").alias("component_id"))
    named = placed.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "row_hash", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
