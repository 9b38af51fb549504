"""Hard-negative mining with Kronecker-packed products (operator 13).

Components are whole numbers. Biased to be non-negative, the same component of
several candidates is put into separated fields of one wide integer; it is
multiplied once by the anchor's (biased) component, and the sum over the
components holds every candidate's score in its field. A field is as wide as
the largest possible sum, so nothing carries over; the biases' share is
subtracted after unpacking. If two fields or more fit into the 53 bits that a
double holds exactly, the products of a block are one matrix product; else the
wide integers are Python's.

The anchors (a stated query set) meet all rows in blocks: a chunk of bounded
size goes to every task, which scans its split once for the positives and once
for the negatives and keeps a running first-k list for each anchor; the lists
are merged by a window whose groups hold k rows of each task at most. There
are as many pairs of scans as chunks. No row leaves its task otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodline.llm.common import written
from moodline.sources.tables import spread

SCALE = 256
#: Components beyond this size count as this size (0 in the given tables).
MAX_COMPONENT = 1 << 53
#: Whole numbers below 2^53 are exact in a double.
EXACT_BITS = 53
#: Bound of the anchors that a pass hands to every task, as 64-bit numbers.
CHUNK_BYTES = 8 << 20
ANCHOR_ROWS, CANDIDATE_ROWS = 512, 2048
#: Scores of rows with a null id come after those of all others.
NO_ID = np.iinfo(np.int64).max


def field_bits(dims: int, anchor_max: int, candidate_max: int) -> int:
    """Bits of the largest sum of ``dims`` products of biased components."""
    return max(1, (dims * 2 * anchor_max * 2 * candidate_max).bit_length())


def packed_scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of all ``anchors`` with all ``rows`` (whole numbers,
    one vector a line): int64, or Python integers where those are too narrow."""
    (n_a, dims), n = anchors.shape, len(rows)
    if not (n_a and n and dims):
        return np.zeros((n_a, n), np.int64)
    a_bias, r_bias = int(np.abs(anchors).max()), int(np.abs(rows).max())
    bits = field_bits(dims, a_bias, r_bias)
    fields = EXACT_BITS // bits
    if fields < 2:
        return _wide_scores(anchors, rows, a_bias, r_bias, (bits + 7) // 8)
    wide = -(-n // fields)
    padded = np.zeros((wide * fields, dims), np.int64)
    padded[:n] = rows + r_bias
    shifts = np.arange(fields, dtype=np.int64) * bits
    packed = (padded.reshape(wide, fields, dims) << shifts[None, :, None]).sum(axis=1)
    sums = ((anchors + a_bias).astype(np.float64) @ packed.T.astype(np.float64)).astype(np.int64)
    raw = (sums[:, :, None] >> shifts) & ((1 << bits) - 1)
    bias = a_bias * rows.sum(axis=1)[None, :] + r_bias * anchors.sum(axis=1)[:, None] + dims * a_bias * r_bias
    return raw.reshape(n_a, wide * fields)[:, :n] - bias


def _wide_scores(anchors: np.ndarray, rows: np.ndarray, a_bias: int, r_bias: int, size: int) -> np.ndarray:
    """The same with Python's integers, fields of ``size`` bytes."""
    n, dims = rows.shape
    lists, own = rows.tolist(), anchors.tolist()
    wide = [int.from_bytes(b"".join((r[d] + r_bias).to_bytes(size, "little") for r in lists), "little")
            for d in range(dims)]
    row_sums = [sum(r) for r in lists]
    out = np.empty((len(own), n), object)
    for i, a in enumerate(own):
        raw = sum((x + a_bias) * w for x, w in zip(a, wide, strict=True)).to_bytes(n * size, "little")
        fixed = r_bias * sum(a) + dims * a_bias * r_bias
        out[i] = [int.from_bytes(raw[k * size:(k + 1) * size], "little") - a_bias * row_sums[k] - fixed
                  for k in range(n)]
    return out


class FirstK:
    """The ``k`` first rows of each group seen so far, by falling score, then
    rising id, then row."""

    def __init__(self, groups: int, k: int, dtype) -> None:
        self.k = k
        self.least = np.full(groups, -(1 << 62) if dtype != object else -(1 << 200), dtype)
        self.group, self.score = np.empty(0, np.int64), np.empty(0, dtype)
        self.vec, self.row = np.empty(0, np.int64), np.empty(0, np.int64)

    def offer(self, group: np.ndarray, score: np.ndarray, vec: np.ndarray, row: np.ndarray) -> None:
        group, score = np.concatenate([self.group, group]), np.concatenate([self.score, score])
        vec, row = np.concatenate([self.vec, vec]), np.concatenate([self.row, row])
        order = np.lexsort((row, vec))
        order = order[np.argsort(-score[order], kind="stable")]
        order = order[np.argsort(group[order], kind="stable")]
        sorted_group = group[order]
        first = np.searchsorted(sorted_group, sorted_group)
        place = np.arange(len(order)) - first
        keep = order[place < self.k]
        last = order[place == self.k - 1]
        self.least[group[last]] = score[last]
        self.group, self.score, self.vec, self.row = group[keep], score[keep], vec[keep], row[keep]


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple]:
    """(row, vec_id or NO_ID, label, components) of at most CANDIDATE_ROWS rows
    at a time, small blocks first: they raise the lists' bounds early."""
    rows = 64
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, rows)
            at, rows = at + rows, min(rows * 2, CANDIDATE_ROWS)
            yield (part.column(0).to_numpy(), part.column(1).fill_null(NO_ID).to_numpy(),
                   part.column(2).to_numpy(), matrix(part.column(3), dims))


def matrix(lists: pa.ListArray, dims: int) -> np.ndarray:
    """Vectors as lines of ``dims`` numbers; what a shorter one lacks is 0."""
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), dims), np.int64)
    out[np.arange(dims)[None, :] < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def _batch(schema: pa.Schema, columns: list[np.ndarray], ids: tuple[int, ...]) -> pa.RecordBatch:
    """Columns as a batch; NO_ID in the columns ``ids`` is null."""
    arrays = []
    for i, (field, values) in enumerate(zip(schema, columns, strict=True)):
        if values.dtype == object:
            from decimal import Decimal
            arrays.append(pa.array([Decimal(v) for v in values], field.type))
        elif pa.types.is_decimal(field.type):
            arrays.append(pa.array(values).cast(pa.decimal128(19, 0)).cast(field.type))
        else:
            arrays.append(pa.array(values, field.type, mask=values == NO_ID if i in ids else None))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


class Chunk:
    """Anchors of one pass, as arrays; goes to every task."""

    def __init__(self, table: pa.Table, dims: int, dtype) -> None:
        table = table.combine_chunks()
        self.dims, self.dtype = dims, dtype
        self.row, self.vec = table["row"].to_numpy(), table["vec_id"].to_numpy()
        self.label = table["label"].to_numpy()
        comps = table["comps"]
        self.comps = matrix(comps.chunk(0) if comps.num_chunks else pa.array([], pa.list_(pa.int64())), dims)

    def scores(self, rows: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        for at in range(0, len(self.row), ANCHOR_ROWS):
            part = slice(at, at + ANCHOR_ROWS)
            yield part, packed_scores(self.comps[part], rows).astype(self.dtype, copy=False)


def _score_type(dtype) -> tuple[str, pa.DataType]:
    return ("decimal(38,0)", pa.decimal128(38, 0)) if dtype == object else ("long", pa.int64())


def _first_rows(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _positives(rows: DataFrame, chunk: Chunk, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids or NO_ID, scores, how many) of the first ``k`` positives of each anchor."""
    sql, arrow = _score_type(chunk.dtype)
    schema = pa.schema([("a", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", arrow)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = FirstK(len(chunk.row), k, chunk.dtype)
        for row, vec, label, comps in _blocks(batches, chunk.dims):
            for part, score in chunk.scores(comps):
                hit = ((chunk.label[part][:, None] == label) & (chunk.row[part][:, None] != row)
                       & (score >= best.least[part][:, None]))
                a, c = np.nonzero(hit)
                if len(a):
                    best.offer(a + part.start, score[a, c], vec[c], row[c])
        yield _batch(schema, [best.group, best.row, best.vec, best.score], (2,))

    found = _first_rows(rows.mapInArrow(run, f"a long, row long, vec_id long, score {sql}"), ["a"], k).collect()
    ids = np.full((len(chunk.row), k), NO_ID)
    scores, n = np.zeros((len(chunk.row), k), chunk.dtype), np.zeros(len(chunk.row), np.int64)
    for r in found:  # at most k for each anchor of the chunk
        a, j = r["a"], r["rank"] - 1
        ids[a, j] = NO_ID if r["vec_id"] is None else r["vec_id"]
        scores[a, j] = int(r["score"])
        n[a] = max(n[a], j + 1)
    return ids, scores, n


def _negatives(rows: DataFrame, chunk: Chunk, positives: tuple, k: int, low: int, high: int) -> DataFrame:
    """The first ``k`` rows of another label whose score is from ``low`` to
    ``high`` percent of the positive's, for each anchor and positive."""
    ids, p_scores, n = positives
    width = ids.shape[1]
    sql, arrow = _score_type(chunk.dtype)
    # from ceil(low * p / 100) to floor(high * p / 100); nothing without a positive
    least, most = -((-low * p_scores) // 100), (high * p_scores) // 100
    missing = np.arange(width)[None, :] >= n[:, None]
    least[missing], most[missing] = 1, 0
    schema = pa.schema([("a", pa.int64()), ("j", pa.int64()), ("anchor_id", pa.int64()), ("positive_id", pa.int64()),
                        ("positive_score", arrow), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", arrow)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = FirstK(len(chunk.row) * width, k, chunk.dtype)
        bound = best.least.reshape(-1, width)  # a view
        for row, vec, label, comps in _blocks(batches, chunk.dims):
            for part, score in chunk.scores(comps):
                other = chunk.label[part][:, None] != label
                found = []
                for j in range(width):
                    floor = np.maximum(bound[part, j], least[part, j])
                    hit = (score >= floor[:, None]) & (score <= most[part, j][:, None]) & other
                    a, c = np.nonzero(hit)
                    found.append(((a + part.start) * width + j, a, c))
                g, a, c = (np.concatenate(x) for x in zip(*found, strict=True))
                if len(g):
                    best.offer(g, score[a, c], vec[c], row[c])
        a, j = best.group // width, best.group % width
        yield _batch(schema, [a, j, chunk.vec[a], ids[a, j], p_scores[a, j], best.row, best.vec, best.score], (3, 6))

    found = rows.mapInArrow(run, f"a long, j long, anchor_id long, positive_id long, positive_score {sql}, "
                                 f"row long, vec_id long, score {sql}")
    return _first_rows(found, ["a", "j"], k).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"),
        _as_long(F.col("positive_score"), sql).alias("positive_score"), _as_long(F.col("score"), sql).alias("negative_score"))


def _as_long(score: Column, sql: str) -> Column:
    if sql == "long":
        return score
    return F.greatest(F.least(score, F.lit((1 << 63) - 1)), F.lit(-(1 << 63))).cast("long")


def prepare(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """row (unique), vec_id, label (mended where the id is divisible by 7),
    comps (floor(256 x)) of the rows that take part, written once."""
    v, label = F.col(vector_col), F.col(label_col).cast("long")
    # a null, NaN or infinite component: x - x is then not 0
    finite = F.forall(v, lambda x: F.coalesce((x - x) == F.lit(0), F.lit(False)))
    scaled = F.transform(v, lambda x: F.floor(F.greatest(F.least(
        x.cast("double") * SCALE, F.lit(float(MAX_COMPONENT))), F.lit(-float(MAX_COMPONENT)))).cast("long"))
    taking_part = df.filter(F.col(label_col).isNotNull() & v.isNotNull() & finite)
    return written(taking_part.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"),
        F.when(F.col(id_col) % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), scaled.alias("comps")))


def mine_negatives(df: DataFrame, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90,
                   anchor_every: int = 100, chunk_bytes: int = CHUNK_BYTES, id_col: str = "vec_id",
                   vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score,
    negative_score: for each anchor (row whose id is divisible by
    ``anchor_every``) and each of its first ``n_positives`` other rows of the
    same label the first ``n_negatives`` rows of another label with
    low * positive <= 100 * negative <= high * positive. Higher scores come
    first, ties by smaller id, then in the order of the rows.

    Rows with a null label, vector or component or a component that is not
    finite take no part. A row without an id is no anchor, keeps its label and
    comes last among ties; its id is given as null. Repeated rows (equal ids or all equal) are rows of
    their own. Vectors may differ in length: what a shorter one lacks counts
    as 0; an empty vector scores 0. Components beyond 2^53 count as 2^53;
    scores are compared exactly and given as the nearest long. An empty table,
    or one without anchors, gives no row. Other columns are not read, whatever
    their names."""
    rows = prepare(df, id_col, vector_col, label_col)
    is_anchor = F.col("vec_id") % anchor_every == 0
    size, largest, n_anchors = rows.agg(
        F.max(F.size("comps")), F.max(F.array_max(F.transform("comps", F.abs))), F.count_if(is_anchor)).first()
    dims, largest = size or 0, largest or 0
    dtype = np.dtype(np.int64) if dims * largest * largest * max(low, high, 100) < 1 << 62 else np.dtype(object)
    chunks = max(1, -(-n_anchors * 8 * (dims + 3) // chunk_bytes))
    anchors = rows.filter(is_anchor)
    anchors = written(anchors) if chunks > 1 else anchors
    rows = spread(rows, "row")
    parts = []
    for i in range(chunks):
        own = anchors.filter(F.pmod(F.xxhash64("row"), F.lit(chunks)) == i) if chunks > 1 else anchors
        chunk = Chunk(own.orderBy("row").toArrow(), dims, dtype)
        found = _negatives(rows, chunk, _positives(rows, chunk, n_positives), n_negatives, low, high)
        parts.append(written(found) if chunks > 1 else found)
    return reduce(DataFrame.unionByName, parts)
