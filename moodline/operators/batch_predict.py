"""Batch scoring in Python workers, in place (K2).

Tokens are made natively; Arrow batches of (keys, token array) go to the
workers, which look the tokens up in the weights and add them per text. The
weights come from a Spark broadcast, so only models within the broadcast
bounds are scored this way. Nothing is shuffled: a text is scored in the task
that read it. Softmax and rounding are the native expressions of the scorer,
over the same integer sums, so results equal K1's.

A batch that fails is scored row by row; a row that fails by itself gets null
sums and is reported as ``Error`` by the callers, the others keep their place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from moodline.functions import text as T
from moodline.operators import naive_bayes as nb
from moodline.operators.encoding import TokenLookup, slices
from moodline.operators.joins import fits_broadcast

SUMS = ["s0", "s1", "s2", "n_known"]
#: (token arrays, vocabulary, weights) -> n x 4 sums and known tokens.
Scorer = Callable[[pa.ListArray, TokenLookup, np.ndarray], np.ndarray]


def token_sums(tokens: pa.ListArray, vocabulary: TokenLookup, weights: np.ndarray) -> np.ndarray:
    """Per text: the three weight sums over its known tokens, and their number.
    The last line of ``weights`` is that of an unknown token."""
    rows = weights[vocabulary.places(tokens.flatten())]
    running = np.zeros((len(rows) + 1, rows.shape[1]), np.int64)
    np.cumsum(rows, axis=0, out=running[1:])
    ends = np.cumsum(pc.list_value_length(tokens).fill_null(0).to_numpy())
    return running[ends] - running[np.concatenate([[0], ends[:-1]]).astype(np.int64)]


def sums_in_place(model: nb.NBModel, docs: DataFrame, keys: list[str], text: str = "text",
                  scorer: Scorer = token_sums) -> DataFrame:
    """keys..., s0, s1, s2, n_known of every row (n_known 0 without a known
    token; null sums and n_known where scoring failed)."""
    sc = docs.sparkSession.sparkContext
    table = model.weights.select("token", "wq0", "wq1", "wq2").toArrow()
    vocabulary = TokenLookup(table["token"].combine_chunks())
    # a weight is the logarithm of a share, times a million: four bytes hold it
    weights = np.zeros((table.num_rows + 1, len(SUMS)), np.int32)
    for c in range(nb.N_CLASSES):
        weights[:-1, c] = table[f"wq{c}"].to_numpy()[vocabulary.order]
    weights[:-1, -1] = 1
    del vocabulary.order
    shared = sc.broadcast((vocabulary, weights))
    rows = docs.select(*keys, T.tokens(F.col(text)).alias("_tokens"))
    fields = [f for f in rows.schema.fields if f.name != "_tokens"]
    schema = Ty.StructType(fields + [Ty.StructField(c, Ty.LongType()) for c in SUMS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, own = shared.value
        for whole in batches:
            size = pc.list_value_length(whole.column(whole.num_columns - 1)).fill_null(0).to_numpy()
            for at, stop in slices(size):  # the sums' memory is bounded by a slice's tokens
                batch = whole.slice(at, stop - at)
                tokens = batch.column(batch.num_columns - 1)
                failed = np.zeros(len(tokens), bool)
                try:
                    sums = scorer(tokens, vocabulary, own)
                except Exception:  # one bad text must not fail its slice
                    sums = np.zeros((len(tokens), len(SUMS)), np.int64)
                    for i in range(len(tokens)):
                        try:
                            sums[i] = scorer(tokens.slice(i, 1), vocabulary, own)[0]
                        except Exception:
                            failed[i] = True
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], *(pa.array(sums[:, c], mask=failed) for c in range(len(SUMS)))],
                    [*batch.schema.names[:-1], *SUMS])

    return rows.mapInArrow(run, schema)


def can_score_in_place(model: nb.NBModel) -> bool:
    return fits_broadcast(model.weights, "token", model.vocab_size)
