"""Vocabulary with ids and fixed-length encoding.

The whole text is encoded: a text of n tokens becomes ceil(n / 126) chunks,
each ``[start] ids... [end]`` padded to 128 with its attention mask. Groups of
the final aggregation are chunks and hold at most 126 elements.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from moodline.functions import text as T
from moodline.operators.joins import broadcast_bound, checked_lookup_join, fits_broadcast, materialize

# Sequence length and reserved ids.
MAX_LENGTH = 128
CHUNK_TOKENS = MAX_LENGTH - 2
PAD_ID, START_ID, END_ID, UNKNOWN_ID = 0, 1, 2, 3
FIRST_WORD_ID = 4
#: Tokens looked up and chunks built at a time.
SLICE_TOKENS, SLICE_CHUNKS = 1 << 18, 1 << 13
#: Column of the tokens that a lookup in place does not know: slot in input_ids, token.
REST = "_rest"
REST_TYPE = Ty.ArrayType(Ty.StructType([Ty.StructField("slot", Ty.IntegerType()), Ty.StructField("token", Ty.StringType())]))
#: Longer tokens are joined.
MAX_NEAR_BYTES = 256
#: Hash ranges in which the tokens of one frequency are numbered.
RANK_BITS = 16


def vocabulary(docs: DataFrame, text: str = "text", size: int | None = None) -> DataFrame:
    """token, token_id, n_occ: all tokens, numbered from FIRST_WORD_ID by
    falling count, ties by md5 then token. A ``size`` keeps the first ids only
    (the other tokens then encode as unknown).

    No row-level sort of the table: the histogram of counts (at most
    sqrt(2 x occurrences) rows) gives the first id of each frequency, counts
    per (frequency, hash range) give the first id of each range, and tokens
    are ranked inside one range of one frequency, 1/65536 of the largest class.
    """
    counts = materialize(T.token_rows(docs, text=text).groupBy("token").agg(F.count(F.lit(1)).alias("n_occ")))
    keyed = counts.withColumn("_md5", F.md5("token")).withColumn(
        "_range", F.conv(F.substring("_md5", 1, RANK_BITS // 4), 16, 10).cast("int"))
    ranges = materialize(keyed.groupBy("n_occ", "_range").agg(F.count(F.lit(1)).alias("_n")))
    per_count = ranges.groupBy("n_occ").agg(F.sum("_n").alias("_n"))
    first = per_count.select("n_occ", (F.sum("_n").over(Window.orderBy(F.desc("n_occ"))) - F.col("_n")).alias("_first"))
    inside = ranges.select("n_occ", "_range", (F.sum("_n").over(
        Window.partitionBy("n_occ").orderBy("_range")) - F.col("_n")).alias("_before"))
    offsets = inside.join(first, "n_occ").select("n_occ", "_range", (F.col("_first") + F.col("_before")).alias("_offset"))
    rank = F.row_number().over(Window.partitionBy("n_occ", "_range").orderBy("_md5", "token"))
    out = keyed.withColumn("_rank", rank).join(offsets, ["n_occ", "_range"]).select(
        "token", (F.col("_offset") + F.col("_rank") + (FIRST_WORD_ID - 1)).alias("token_id"), "n_occ")
    return out if size is None else out.filter(F.col("token_id") < FIRST_WORD_ID + size)


def encode(docs: DataFrame, vocab: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, chunk, n_tokens (whole text), input_ids, attention_mask; no row for
    a text without tokens. Ids are looked up where the text was read if the
    vocabulary is within the broadcast bounds; beyond them those of the most
    frequent tokens are, and the rare ones by a join of their occurrences."""
    lookup = materialize(vocab.select("token", "token_id"))
    n_tokens = lookup.count()
    toks = docs.select(key, T.tokens(F.col(text)).alias("_toks"))
    if fits_broadcast(lookup, "token", n_tokens):
        return _encode_in_place(toks, lookup, key).drop(REST)
    # frequent tokens have the smallest ids: nearly all occurrences are looked
    # up in place, and only the others are joined and put into their chunks
    near = ((F.col("token_id") < FIRST_WORD_ID + broadcast_bound(docs.sparkSession))
            & (F.octet_length("token") <= MAX_NEAR_BYTES))
    chunks = materialize(_encode_in_place(toks, lookup.filter(near), key)
                         .withColumn("_row", F.monotonically_increasing_id()))
    done = chunks.filter(F.size(REST) == 0).drop(REST, "_row")
    some = chunks.filter(F.size(REST) > 0)
    far = materialize(lookup.filter(~near))
    occ = some.select("_row", F.explode(REST).alias("_t")).select("_row", "_t.slot", "_t.token")
    ids = checked_lookup_join(occ, far, "token", far.count(), how="left")
    # at most CHUNK_TOKENS of a chunk
    found = ids.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct(
        "slot", F.coalesce(F.col("token_id"), F.lit(UNKNOWN_ID)).cast("long")))).alias("_ids"))
    filled = F.transform("input_ids", lambda x, i: F.coalesce(F.try_element_at(F.col("_ids"), i), x))
    return done.unionByName(some.join(found, "_row").withColumn("input_ids", filled).select(*done.columns))


class TokenLookup:
    """Places of tokens in a vocabulary, whose own order is that of their
    hashes: one array to search, made once and not for every slice. Tokens are
    compared in full, so equal hashes only cost a further step."""

    def __init__(self, tokens: pa.Array) -> None:
        hashes = token_hashes(tokens)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes, self.tokens = hashes[self.order], tokens.take(pa.array(self.order))

    def __len__(self) -> int:
        return len(self.hashes)

    def places(self, tokens: pa.Array) -> np.ndarray:
        """The place of each token, or the vocabulary's size."""
        coded = tokens.dictionary_encode()
        different = coded.dictionary
        hashes = token_hashes(different)
        at = np.searchsorted(self.hashes, hashes)
        out = np.full(len(different) + 1, len(self))
        left = np.arange(len(different))
        while len(left):
            left = left[at[left] < len(self)]
            left = left[self.hashes[at[left]] == hashes[left]]
            same = pc.equal(self.tokens.take(pa.array(at[left])), different.take(pa.array(left))).to_numpy(zero_copy_only=False)
            out[left[same]] = at[left[same]]
            left = left[~same]
            at[left] += 1
        return out[coded.indices.fill_null(len(different)).to_numpy()]


def token_hashes(tokens: pa.Array) -> np.ndarray:
    """A 64-bit number of each token, from its bytes."""
    tokens = tokens.cast(pa.large_binary())
    ends = np.frombuffer(tokens.buffers()[1], np.int64)[tokens.offset:tokens.offset + len(tokens) + 1] if len(tokens) else np.zeros(1, np.int64)
    size = np.diff(ends)
    raw = np.frombuffer(tokens.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    place = np.arange(len(raw)) - np.repeat(ends[:-1] - ends[0], size)
    power = np.cumprod(np.full(int(size.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw + np.uint64(1)) * power[place], dtype=np.uint64)])
    out = total[ends[1:] - ends[0]] - total[ends[:-1] - ends[0]]
    return (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def chunk_schema(key: Ty.StructField) -> Ty.StructType:
    return Ty.StructType([key, Ty.StructField("chunk", Ty.LongType()), Ty.StructField("n_tokens", Ty.IntegerType()),
                          Ty.StructField("input_ids", Ty.ArrayType(Ty.LongType())),
                          Ty.StructField("attention_mask", Ty.ArrayType(Ty.IntegerType()))])


def slices(size: np.ndarray, most: int = SLICE_TOKENS) -> Iterator[tuple[int, int]]:
    """(from, to) of neighbouring rows with about ``most`` tokens together, or
    one longer text."""
    ends = np.cumsum(size, dtype=np.int64)
    at = 0
    while at < len(size):
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield at, stop
        at = stop


def token_slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.ListArray]]:
    """(keys, token lists) of the slices of a (key, tokens) batch."""
    for at, stop in slices(pc.list_value_length(batch.column(1)).fill_null(0).to_numpy()):
        part = batch.slice(at, stop - at)
        yield part.column(0), part.column(1)


def chunk_slices(keys: pa.Array, size: np.ndarray, flat: np.ndarray, key: str, start_id: int = START_ID,
                 end_id: int = END_ID, pad_id: int = PAD_ID) -> Iterator[pa.RecordBatch]:
    """Rows (key, chunk, n_tokens, input_ids, attention_mask) of texts with
    ``size`` ids each, one after the other in ``flat``; SLICE_CHUNKS at a time."""
    first = np.cumsum(size) - size
    parts = -(-size // CHUNK_TOKENS)
    every = np.repeat(np.arange(len(size)), parts)
    number = np.arange(len(every)) - np.repeat(np.cumsum(parts) - parts, parts)
    place = np.arange(CHUNK_TOKENS)
    for at in range(0, len(every), SLICE_CHUNKS):
        owner, chunk = every[at:at + SLICE_CHUNKS], number[at:at + SLICE_CHUNKS]
        n = np.minimum(CHUNK_TOKENS, size[owner] - chunk * CHUNK_TOKENS)
        inside = place < n[:, None]
        ids = np.full((len(owner), MAX_LENGTH), pad_id, np.int64)
        ids[:, 0] = start_id
        ids[:, 1:-1][inside] = flat[((first[owner] + chunk * CHUNK_TOKENS)[:, None] + place)[inside]]
        ids[np.arange(len(owner)), n + 1] = end_id
        mask = (np.arange(MAX_LENGTH) < (n + 2)[:, None]).astype(np.int32)
        edges = pa.array(np.arange(len(owner) + 1, dtype=np.int32) * MAX_LENGTH)
        yield pa.RecordBatch.from_arrays(
            [keys.take(pa.array(owner)), pa.array(chunk.astype(np.int64)), pa.array(size[owner].astype(np.int32)),
             pa.ListArray.from_arrays(edges, pa.array(ids.ravel())), pa.ListArray.from_arrays(edges, pa.array(mask.ravel()))],
            [key, "chunk", "n_tokens", "input_ids", "attention_mask"])


def _encode_in_place(toks: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """The chunks of each token array, made in Arrow batches without a shuffle,
    a bounded number of tokens at a time; unknown tokens also in column REST,
    with their places in the chunk."""
    table = lookup.toArrow()
    vocabulary = TokenLookup(table["token"].combine_chunks())
    known = np.append(table["token_id"].to_numpy()[vocabulary.order], UNKNOWN_ID)
    del vocabulary.order
    shared = toks.sparkSession.sparkContext.broadcast((vocabulary, known))
    schema = Ty.StructType([*chunk_schema(toks.schema[key]).fields, Ty.StructField(REST, REST_TYPE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, known = shared.value
        for batch in batches:
            for keys, tokens in token_slices(batch):
                flat = tokens.flatten()
                at = vocabulary.places(flat)
                size = pc.list_value_length(tokens).fill_null(0).to_numpy().astype(np.int64)
                # chunk (over the slice) and place of each unknown token
                parts = -(-size // CHUNK_TOKENS)
                unknown = np.flatnonzero(at == len(vocabulary))
                owner = np.searchsorted(np.cumsum(size), unknown, side="right")
                place = unknown - (np.cumsum(size) - size)[owner]
                chunk = (np.cumsum(parts) - parts)[owner] + place // CHUNK_TOKENS
                rest = pa.StructArray.from_arrays(
                    [pa.array((place % CHUNK_TOKENS + 1).astype(np.int32)), flat.take(pa.array(unknown))], ["slot", "token"])
                done = 0
                for rows in chunk_slices(keys, size, known[at], key):
                    edges = np.searchsorted(chunk, np.arange(done, done + rows.num_rows + 1)).astype(np.int32)
                    done += rows.num_rows
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.ListArray.from_arrays(pa.array(edges), rest)],
                                                     [*rows.schema.names, REST])

    return toks.mapInArrow(run, schema)
