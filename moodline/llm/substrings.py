"""Removal of byte strings that occur twice in a corpus (operator 3).

Every string of ``LENGTH`` bytes that starts at two places is removed at both.
A suffix array of the whole corpus is cut into small ones that can be sorted
apart:

1. Anchors. Each window of ``LENGTH`` bytes has one anchor, its smallest-hashed
   ``GRAM`` bytes (leftmost of equals). Equal windows have equal anchors at
   equal offsets. A *piece* is the run of neighbouring windows of one anchor;
   a text of n bytes has about n / 85 pieces. Pieces repeated within a text are
   settled there, and one of them goes on.
2. Pieces whose anchor gram is nowhere else are dropped (partial aggregates).
   A piece that equals another one is repeated as a whole, by its 128-bit key.
3. What is left are the rims of repeated passages: different pieces with equal
   grams. Their bytes are fetched; buckets of equal grams are put together to
   chunks of about a megabyte. Windows whose surroundings differ from all
   others of the bucket are left out, the rest is sorted with the two-stage
   suffix sort, and common prefixes of neighbours tell which are repeated.
   A bucket of more than ``HOT_PIECES`` different pieces is first split by the
   bytes around its gram: the range of window offsets is halved, and each half
   is keyed by all bytes its windows share, until the buckets are small or a
   half is one window, whose key is the window itself.
4. Spans are gathered per document and cut out. Text is shuffled only for
   documents that lend bytes to step 3 or lose some in step 4.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodline.llm.common import drop_written, written
from moodline.llm.suffix import repeated_starts

LENGTH = 200
GRAM = 32
#: Grams of a window, which is also the number of offsets an anchor can have.
OFFSETS = LENGTH - GRAM + 1
HOT_PIECES = 1000
CHUNK_BYTES = 1 << 20
#: Offset ranges are not halved below this when windows are left out.
LEAF_OFFSETS = 16
#: Window starts that are looked at together in a long text.
BLOCK = 1 << 21
#: Size of the filters that keep text of documents without a hit in place.
SLOTS = 1 << 20

_POS_BITS = np.uint64(22)
_POS_MASK = np.uint64((1 << 22) - 1)


@lru_cache(maxsize=1)
def _tables() -> tuple:
    """Byte values and powers (and inverse powers) of two rolling hashes mod 2**64."""
    rng = np.random.default_rng(20_200)
    out = []
    for _ in range(2):
        values = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(rng.integers(0, 1 << 62, dtype=np.uint64)) * 4 + 3
        size = BLOCK + LENGTH + 1
        out.append((values, _powers(base, size), _powers(pow(base, -1, 1 << 64), size)))
    return tuple(out)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _range_hash(prefix: np.ndarray, inverse: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (prefix[end] - prefix[start]) * inverse[start]


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    n = len(v)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = v
    table = padded.reshape(blocks, width)
    head = np.minimum.accumulate(table, axis=1).ravel()
    tail = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n - width + 1], head[width - 1:n])


def pieces_of(raw: bytes) -> tuple[np.ndarray, ...]:
    """(first window, windows, offset of the anchor in the first window, gram
    hash, piece hash) of each piece of ``raw``, in order."""
    out: list[tuple] = []
    data = np.frombuffer(raw, np.uint8)
    (values, power, inverse), (values2, power2, inverse2) = _tables()
    for at in range(0, len(raw) - LENGTH + 1, BLOCK):
        part = data[at:at + BLOCK + LENGTH - 1]
        n = len(part)
        prefix, prefix2 = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
        np.cumsum(values[part] * power[:n], out=prefix[1:])
        np.cumsum(values2[part] * power2[:n], out=prefix2[1:])
        grams = n - GRAM + 1
        gram = _mix((prefix[GRAM:] - prefix[:-GRAM]) * inverse[:grams])
        least = sliding_min((gram >> _POS_BITS << _POS_BITS) | np.arange(grams, dtype=np.uint64), OFFSETS)
        anchor = (least & _POS_MASK).astype(np.int64)
        first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        count = np.diff(np.append(first, len(anchor)))
        own = anchor[first]
        whole = _mix(_range_hash(prefix2, inverse2, first, first + count - 1 + LENGTH) + count.astype(np.uint64))
        out.append((first + at, count, own - first, gram[own], whole))
    if not out:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of ranges as maximal runs (touching ranges are one)."""
    if not len(start):
        return start, end
    by = np.argsort(start, kind="stable")
    start, end = start[by], np.maximum.accumulate(end[by])
    new = np.append(True, start[1:] > end[:-1])
    return start[new], end[np.append(new[1:], True)]


_PIECES = "id long, h long, place long, gram long, piece long, n int"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a text: its different pieces with n = 1 or 2 (found once, or
    more often) and, with n = 0, the ranges settled here (gram, piece: start, end)."""
    names = [c.split()[0] for c in _PIECES.split(", ")]
    for batch in batches:
        cols: list[list[np.ndarray]] = [[] for _ in names]
        ids, hs = batch.column(0), batch.column(1).to_numpy()
        owner: list[np.ndarray] = []
        for row in range(batch.num_rows):
            raw = batch.column(2)[row].as_py().encode()
            if len(raw) < LENGTH:
                continue
            first, count, offset, gram, whole = pieces_of(raw)
            _, at, back, times = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
            again = times[back] > 1
            start, end = merged(first[again], (first + count - 1 + LENGTH)[again])
            n = len(at) + len(start)
            owner.append(np.full(n, row))
            zero = np.zeros(len(start), np.int64)
            for col, new in zip(cols[2:], (
                    [(first << 16 | offset << 8 | count)[at], zero], [gram[at].view(np.int64), start],
                    [whole[at].view(np.int64), end], [np.minimum(times, 2), zero]), strict=True):
                col += new
        if owner:
            rows = pa.array(np.concatenate(owner))
            place, gram, piece, n = (np.concatenate(c) for c in cols[2:])
            yield pa.RecordBatch.from_arrays(
                [ids.take(rows), pa.array(hs).take(rows), pa.array(place), pa.array(gram), pa.array(piece),
                 pa.array(n.astype(np.int32))], names)


def candidate_windows(rows: list[dict]) -> list[list[tuple[int, int]]]:
    """For each piece of a bucket the runs (first, end) of windows that may be
    repeated: offset ranges are halved while at least two pieces, one of them
    open, agree on all bytes that the windows of a half share."""
    ranges: list[list[tuple[int, int]]] = [[] for _ in rows]

    def halve(items: list[int], lo: int, hi: int) -> None:
        if hi - lo <= LEAF_OFFSETS:
            for i in items:
                ranges[i].append((lo, hi))
            return
        mid = (lo + hi) // 2
        for a, b in ((mid, hi), (lo, mid)):
            groups: dict[bytes, list[int]] = {}
            for i in items:
                r = rows[i]
                if a <= r["offset"] and r["offset"] - r["windows"] + 1 < b:
                    groups.setdefault(r["raw"][r["offset"] - a:r["offset"] - b + 1 + LENGTH], []).append(i)
            for same in groups.values():
                if len(same) > 1 and any(rows[i]["open"] for i in same):
                    halve(same, a, b)

    halve(list(range(len(rows))), rows[0]["lo"], rows[0]["hi"])
    out = []
    for r, found in zip(rows, ranges, strict=True):
        runs: list[tuple[int, int]] = []
        for lo, hi in found:  # falling offsets are rising windows
            first, end = max(0, r["offset"] - hi + 1), min(r["windows"], r["offset"] - lo + 1)
            if runs and runs[-1][1] == first:
                runs[-1] = (runs[-1][0], end)
            elif first < end:
                runs.append((first, end))
        out.append(runs)
    return out


_SPANS = "id long, h long, start long, end long"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated ranges of the open pieces; rows come sorted by bucket."""
    held: list[dict] = []
    size = 0

    def settle(rows: list[dict]) -> pa.RecordBatch:
        found: list[list] = [[], [], [], []]
        parts: list[tuple[dict, int, bytes]] = []
        for _, bucket in groupby(rows, key=lambda r: r["key"]):
            own = list(bucket)
            parts += [(r, first, r["raw"][first:end - 1 + LENGTH])
                      for r, runs in zip(own, candidate_windows(own), strict=True) for first, end in runs]
        for (row, first, _), starts in zip(parts, repeated_starts([p[2] for p in parts], LENGTH), strict=True):
            if row["open"] and len(starts):
                start, end = merged(starts, starts + LENGTH)
                found[0] += [row["id"]] * len(start)
                found[1] += [row["h"]] * len(start)
                found[2] += (start + row["pos"] + first).tolist()
                found[3] += (end + row["pos"] + first).tolist()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["id", "h", "start", "end"])

    for batch in batches:
        for row in batch.to_pylist():
            if size >= CHUNK_BYTES and row["key"] != held[-1]["key"]:
                yield settle(held)
                held, size = [], 0
            held.append(row)
            size += len(row["raw"])
    if held:
        yield settle(held)


def _slot(*cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(SLOTS))


def _text_of(docs: DataFrame, listed: DataFrame, how: str) -> DataFrame:
    """``docs`` (id, h, text) joined to the one row per (id, h) of ``listed``.
    The broadcast slots (at most ``SLOTS`` integers) keep all other texts out
    of the shuffle."""
    slots = listed.select(_slot("id", "h").alias("_slot")).distinct()
    near = docs.withColumn("_slot", _slot("id", "h")).join(F.broadcast(slots), "_slot").drop("_slot")
    other = listed.withColumnsRenamed({"id": "_id", "h": "_h"})
    return near.join(other, near["id"].eqNullSafe(other["_id"]) & (near["h"] == other["_h"]), how).drop("_id", "_h")


def _halves(rows: DataFrame) -> DataFrame:
    """Each piece cut at the middle of its bucket's offset range; the key of a
    half is made of the bytes that all windows of its range share."""
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    smallest = F.col("offset") - F.col("windows") + 1
    low_first = F.least(F.col("offset"), mid - 1)
    upper = F.struct(mid.alias("lo"), F.col("hi").alias("hi"), F.col("offset").alias("offset"),
                     (F.col("offset") - F.greatest(smallest, mid) + 1).alias("windows"))
    lower = F.struct(F.col("lo").alias("lo"), mid.alias("hi"), low_first.alias("offset"),
                     (low_first - smallest + 1).alias("windows"))
    cut = rows.select("key", "id", "h", "pos", "open", "raw", F.col("offset").alias("_was"),
                      F.explode(F.array(upper, lower)).alias("_half")).filter(F.col("_half.windows") > 0)
    shift = F.col("_was") - F.col("_half.offset")
    cut = cut.select("key", "id", "h", (F.col("pos") + shift).alias("pos"), "open", "_half.*",
                     F.substring("raw", shift + 1, F.col("_half.windows") - 1 + LENGTH).alias("raw"))
    core = F.substring("raw", F.col("offset") - F.col("lo") + 1, F.col("lo") - F.col("hi") + 1 + LENGTH)
    return cut.withColumn("key", F.xxhash64("key", "lo", "hi", core))


def _split_hot(rows: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Buckets of at most ``HOT_PIECES`` pieces, and spans settled meanwhile:
    halves that are equal to another one are repeated as a whole."""
    done, spans = [], []
    while True:
        hot = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > HOT_PIECES)
                      .select("key"))
        if hot.isEmpty():
            return reduce(DataFrame.unionByName, [*done, rows]), spans
        done.append(rows.join(hot, "key", "left_anti"))
        halves = written(_halves(rows.join(hot, "key", "left_semi"))
                         .withColumn("_same", F.sha2("raw", 256)))
        # of equal halves one goes on, closed; windows are as many as bytes allow
        same = ["key", "_same", "offset"]
        groups = written(halves.groupBy(*same).agg(
            F.count(F.lit(1)).alias("_n"), F.min_by(F.struct("id", "h", "pos", "open", "lo", "hi", "windows", "raw"),
                                                    F.struct("id", "h", "pos")).alias("_one")))
        twice = groups.filter("_n > 1").select(*same)
        spans.append(halves.filter("open").join(twice, same, "left_semi").select(
            "id", "h", F.col("pos").alias("start"), (F.col("pos") + F.col("windows") - 1 + LENGTH).alias("end")))
        rows = written(groups.select("key", "offset", "_one.*", "_n").withColumn(
            "open", F.col("open") & (F.col("_n") == 1)).drop("_n"))
        # a bucket without an open piece is settled
        live = rows.groupBy("key").agg(F.count_if("open").alias("_open"), F.count(F.lit(1)).alias("_all")).filter(
            "_open > 0 and _all > 1").select("key")
        rows = written(rows.join(live, "key", "left_semi"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """id, h, spans (array of start, end; unordered, may overlap) of the
    documents (id, h, text) that hold a repeated string."""
    scanned = written(docs.mapInArrow(_scan, _PIECES))
    pieces = scanned.filter("n > 0")
    shared = pieces.groupBy("gram").agg(F.sum("n").alias("_n")).filter("_n > 1").select("gram")
    near = written(pieces.join(shared, "gram", "left_semi"))
    settled = written(scanned.filter("n = 0").select("id", "h", F.col("gram").alias("start"), F.col("piece").alias("end")))
    drop_written(scanned)
    kinds = written(near.groupBy("gram", "piece").agg(
        F.sum("n").alias("_n"), F.min_by(F.struct("id", "h", "place"), F.struct("id", "h", "place")).alias("_one")))
    windows = F.col("place").bitwiseAND(255)
    start = F.shiftright("place", 16)
    whole = (near.filter("n = 1").join(kinds.filter("_n > 1").select("gram", "piece"), ["gram", "piece"], "left_semi")
             .select("id", "h", start.alias("start"), (start + windows - 1 + LENGTH).alias("end")))
    # buckets with a piece that is alone and another one to compare it with
    buckets = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("_kinds"), F.count_if(F.col("_n") == 1).alias("_open"))
    rims = kinds.join(buckets.filter("_kinds > 1 and _open > 0").select("gram"), "gram", "left_semi").select(
        F.col("gram").alias("key"), (F.col("_n") == 1).alias("open"), "_one.*")
    listed = written(rims.groupBy("id", "h").agg(F.collect_list(F.struct("key", "open", "place")).alias("_list")))
    cut = _text_of(docs, listed, "inner").select("id", "h", F.col("text").cast("binary").alias("_b"),
                                                 F.explode("_list").alias("_p"))
    place = F.col("_p.place")
    count = place.bitwiseAND(255).cast("int")
    pos = F.shiftright(place, 16)
    rows = written(cut.select(
        F.col("_p.key").alias("key"), "id", "h", pos.alias("pos"), F.col("_p.open").alias("open"),
        F.lit(0).alias("lo"), F.lit(OFFSETS).alias("hi"), F.shiftright(place, 8).bitwiseAND(255).cast("int").alias("offset"),
        count.alias("windows"), F.substring("_b", (pos + 1).cast("int"), count - 1 + LENGTH).alias("raw")))
    small, spans = _split_hot(rows)
    compared = (small.select("key", "id", "h", "pos", "open", "lo", "hi", "offset", "windows", "raw").repartition("key")
                .sortWithinPartitions("key").mapInArrow(_compare, _SPANS))
    every = reduce(DataFrame.unionByName, [settled, whole, *spans, compared])
    return every.groupBy("id", "h").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


_KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            rows = batch.slice(at, 256).to_pylist()
            out: list[list] = [[], [], [], [], []]
            for r in rows:
                raw = r["text"].encode()
                spans = r["spans"] or []
                start, end = merged(np.array([s["start"] for s in spans], np.int64),
                                    np.array([s["end"] for s in spans], np.int64))
                keep, done = [], 0
                for s, e in zip(start.tolist(), end.tolist(), strict=True):
                    keep.append(raw[done:s])
                    done = e
                keep.append(raw[done:])
                for col, v in zip(out, (r["id"], len(raw), int((end - start).sum()), len(start), b"".join(keep)),
                                  strict=True):
                    col.append(v)
            kinds = [pa.int64()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)],
                                             [c.split()[0] for c in _KEPT.split(", ")])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans (maximal
    removed runs) and kept (the remaining bytes; a cut may split a character).

    A null text is empty; texts under ``LENGTH`` bytes are kept whole. Repeated
    rows are repeats of each other, so their long texts go; rows of equal id
    and text share one answer. Further columns are ignored; an empty table
    gives an empty result."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    spans = written(repeated_spans(rows))
    slots = spans.select(_slot("id", "h").alias("_slot")).distinct()
    clean = rows.withColumn("_slot", _slot("id", "h")).join(F.broadcast(slots), "_slot", "left_anti")
    size = F.octet_length("text").cast("long")
    zero = F.lit(0).cast("long")
    clean = clean.select(F.col("id").alias("doc_id"), size.alias("n_bytes"), zero.alias("n_removed"),
                         zero.alias("n_spans"), F.col("text").cast("binary").alias("kept"))
    return clean.unionByName(_text_of(rows, spans, "left").select("id", "text", "spans").mapInArrow(_cut_out, _KEPT))
