"""Language ID by hyperdimensional profiles (operator 2).

Every letter has a random vector of +1/-1 (drawn from its code point, so all
workers agree). An n-gram vector binds its letters: the i-th letter's vector
is permuted by its distance to the end, and the vectors are multiplied. A text
is the bundle (sum) of its n-gram vectors, a language prototype the bundle of
its training texts; a text gets the language with the largest cosine.

Training reads a bounded share of the labelled rows (``TRAIN_PER_LANG`` a
language, chosen by id hash); prototypes are summed on the executors. The model
is one vector of ``DIM`` integers a language.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodline.llm.common import map_rows

DIM = 2048
NGRAM = 3
SEED = 7919
#: Bound of the training sample, documents per language (expected number).
TRAIN_PER_LANG = 4000
#: Languages with the most labelled rows that are learned; bounds the model.
MAX_LANGS = 512
#: Bounds of ``least_score``, measured on held-out pieces and foreign letters.
SHORT_NGRAMS, LONG_NGRAMS, LEAST_SCORE, MOST_SCORE = 48, 256, 0.065, 0.08
#: Prediction given to a text without a letter.
UNDETERMINED = "und"
#: n-grams bundled at a time; below 2**24 / 2 so that float32 sums are exact.
CHUNK = 1 << 20
_SPACE = 0


@lru_cache(maxsize=8192)
def letter_vector(code_point: int) -> np.ndarray:
    """The random +1/-1 vector of a letter (0: the word gap)."""
    return np.random.default_rng([SEED, code_point]).integers(0, 2, DIM, dtype=np.int8) * 2 - 1


@lru_cache(maxsize=1 << 16)
def _is_letter(code_point: int) -> bool:
    return chr(code_point).isalpha()


def letters(text: str) -> np.ndarray:
    """Lower-cased letters of ``text`` as code points, each run of other
    characters one gap (0), with a gap at both ends."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    kinds, at = np.unique(points, return_inverse=True)
    alpha = np.array([_is_letter(int(c)) for c in kinds], bool)
    points = np.where(alpha[at], points, _SPACE) if len(points) else points
    points = np.concatenate([[_SPACE], points, [_SPACE]])
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != _SPACE) | (points[:-1] != _SPACE)
    return points[keep]


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes (21 bits a letter) and counts of the letter n-grams of a text;
    empty without a letter."""
    points = letters(text or "")
    if not points.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.zeros(len(points) - NGRAM + 1, np.int64)
    for i in range(NGRAM):
        codes = codes << 21 | points[i:len(points) - NGRAM + 1 + i]
    return np.unique(codes, return_counts=True)


def ngram_vectors(codes: np.ndarray) -> np.ndarray:
    """(n, DIM) int8: bound letter vectors of each n-gram code."""
    out = np.ones((len(codes), DIM), np.int8)
    for i in range(NGRAM):
        points = codes >> 21 * (NGRAM - 1 - i) & 0x1FFFFF
        kinds, at = np.unique(points, return_inverse=True)
        # permuted by the letter's distance to the end of the n-gram
        table = np.stack([np.roll(letter_vector(int(c)), NGRAM - 1 - i) for c in kinds])
        out *= table[at]
    return out


def bundles(texts: list[str | None], counted: list | None = None) -> np.ndarray:
    """(n, DIM) float64 document vectors (whole numbers; zero without a letter);
    ``counted``: the texts' n-gram counts, if they are known."""
    counted = [ngram_counts(t) for t in texts] if counted is None else counted
    codes = np.unique(np.concatenate([c for c, _ in counted])) if counted else np.empty(0, np.int64)
    out = np.zeros((len(texts), DIM))
    for start in range(0, len(codes), 1 << 13):  # bounds the table of bound vectors
        part = codes[start:start + (1 << 13)]
        table = ngram_vectors(part).astype(np.float32)
        for row, (own, n) in enumerate(counted):
            lo, hi = np.searchsorted(own, part[0]), np.searchsorted(own, part[-1], "right")
            if lo < hi:
                weight = n[lo:hi]
                exact = np.float32 if weight.sum() < 1 << 23 else np.float64
                out[row] += weight.astype(exact) @ table[np.searchsorted(part, own[lo:hi])]
    return out


@dataclass(frozen=True)
class Model:
    """Languages in name order and their prototypes (whole numbers)."""
    langs: list[str]
    prototypes: np.ndarray

    def predict(self, texts: list[str | None], counted: list | None = None) -> tuple[list[str], list[float]]:
        """Language and cosine (0 to 1) of each text; ties go to the first name."""
        docs = bundles(texts, counted)
        if not self.langs:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        size = np.sqrt((docs * docs).sum(axis=1))
        proto = np.sqrt((self.prototypes * self.prototypes).sum(axis=1))
        cosine = (docs @ self.prototypes.T) / np.maximum(np.outer(size, proto), 1e-300)
        best = cosine.argmax(axis=1)
        lang = [self.langs[b] if s else UNDETERMINED for b, s in zip(best, size, strict=True)]
        score = np.where(size > 0, np.clip(cosine[np.arange(len(texts)), best], 0, 1), 0.0)
        return lang, score.tolist()


def is_held_out(id_col: Column) -> Column:
    """crc32 of the id as text mod 5 is 0; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, per_lang: int = TRAIN_PER_LANG) -> Model:
    """Prototypes of the languages in ``docs`` (doc_id, text, lang), learned
    from rows that are not held out: the ``MAX_LANGS`` with the most such rows
    (ties by name). Rows with a null language or text are not used. Without any
    row the model has no language."""
    known = docs.select("doc_id", "text", "lang").filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out(F.col("doc_id")))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS)
    rows = {r["lang"]: r["n"] for r in counts.collect()}
    if not rows:
        return Model([], np.zeros((0, DIM)))
    share = F.create_map(*[F.lit(v) for lang, n in sorted(rows.items()) for v in (lang, min(1.0, per_lang / n))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = known.filter(draw < share[F.col("lang")]).select("lang", "text")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                piece = batch.slice(start, 256)
                vectors = bundles(piece.column(1).to_pylist())
                for lang, vector in zip(piece.column(0).to_pylist(), vectors, strict=True):
                    total[lang] = total.get(lang, 0) + vector
        if total:
            names = sorted(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array([total[n].astype(np.int64).tolist() for n in names], pa.list_(pa.int64()))],
                ["lang", "v"])

    parts = sample.mapInArrow(add, "lang string, v array<long>")
    sums = (parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
            .toArrow())  # at most MAX_LANGS x DIM rows
    langs = sorted(rows)
    proto = np.zeros((len(langs), DIM))
    place = {lang: i for i, lang in enumerate(langs)}
    proto[[place[x] for x in sums["lang"].to_pylist()], sums["i"].to_numpy()] = sums["x"].to_numpy()
    # whole numbers of at most 20 bits keep the dot products exact
    top = np.maximum(np.abs(proto).max(axis=1, keepdims=True), 1)
    return Model(langs, np.round(proto * np.minimum(1, (1 << 20) / top)))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score. A null text and one
    without a letter are ``und`` with score 0. Of languages with equal cosine
    the first name wins. Whole texts are looked at, in time proportional to
    their length; repeated rows each give a row, an empty table none; other
    columns are not read, whatever their names."""
    def batch(cols: dict) -> dict:
        lang, score = model.predict(cols["text"])
        return {"doc_id": cols["doc_id"], "lang_pred": lang, "score": score}

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")),
                    batch, "doc_id long, lang_pred string, score double")


def least_score(n_ngrams: int) -> float:
    """The cosine that a text of so many n-grams needs. Chance has a standard
    deviation of 1 / sqrt(DIM) = 0.022 whatever the length, but what a text of a
    learned language scores grows with its length: below SHORT_NGRAMS the two
    cannot be told apart and the text stays; then the bound rises from about
    three to nearly four standard deviations."""
    if n_ngrams < SHORT_NGRAMS:
        return 0.0
    return LEAST_SCORE + (MOST_SCORE - LEAST_SCORE) * min(1.0, (n_ngrams - SHORT_NGRAMS) / (LONG_NGRAMS - SHORT_NGRAMS))


def keep_language(docs: DataFrame, model: Model, bound: Callable[[int], float] = least_score) -> DataFrame:
    """Rows of ``docs`` (all columns, whatever their names) whose text has a
    letter and is as much like some language as ``bound`` asks of its number of
    n-grams; decided in place, nothing is joined. Null and empty texts go; equal
    rows share their fate; whole texts are looked at, in time proportional to
    their length; an empty table stays empty, and without a learned language
    every row goes."""
    @F.pandas_udf("boolean")
    def fits(texts):
        import pandas as pd
        out: list[bool] = []
        for start in range(0, len(texts), 256):
            part = [t if isinstance(t, str) else None for t in texts.iloc[start:start + 256]]
            counted = [ngram_counts(t) for t in part]
            lang, score = model.predict(part, counted)
            out += [lg != UNDETERMINED and s >= bound(int(n.sum()))
                    for lg, s, (_, n) in zip(lang, score, counted, strict=True)]
        return pd.Series(out)

    return docs.filter(fits(F.col("text")))
