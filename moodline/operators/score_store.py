"""Scores kept across runs (K3): a text is scored once for a model version, in
whichever run it first appears.

Batches of scores lie under ``<root>/<model>/version=<v>/batch=<n>``: the
scores by text hash, the bits that their hashes set in a Bloom filter, and a
manifest that is written last (a batch without one does not exist). A run asks
the filter first. What the filter does not know is new and meets no stored
score at all; the rest is looked up by a join of hashes, so a false positive
costs a lookup and nothing else. Only texts that are new are read again and
scored; texts that cannot be scored are remembered too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodline.operators import naive_bayes as nb
from moodline.operators import scorer as K
from moodline.operators.joins import broadcast_bound, checked_lookup_join, materialize
from moodline.session import hadoop_path, shared_path

#: Bits of the filter: 2 MB, about 1.6 M texts at ten bits each; with more
#: texts more hashes are looked up in vain. Every batch of a store uses as many.
BLOOM_BITS = 1 << 24
PROBES = 6
SCORES = "_th string, n_known long, p_negative double, p_neutral double, p_positive double"


def bit_places(hashes: list[str], bits: int) -> np.ndarray:
    """(texts, PROBES) places of hexadecimal 256-bit hashes."""
    raw = np.frombuffer(bytes.fromhex("".join(hashes)), ">u8").reshape(-1, 4)
    first, step = raw[:, 0], raw[:, 1] | np.uint64(1)
    return (first[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(bits)


def bloom_words(hashes: DataFrame, bits: int) -> DataFrame:
    """word, mask: the 64-bit words of the filter that the hashes set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            at = bit_places(batch.column(0).to_pylist(), bits).ravel()
            np.bitwise_or.at(words, (at // np.uint64(64)).astype(np.int64), np.uint64(1) << at % np.uint64(64))
        seen = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(words[seen].view(np.int64))], ["word", "mask"])

    return hashes.select("_th").mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask"))


def might_know(hashes: DataFrame, words: np.ndarray) -> DataFrame:
    """Adds ``_maybe``: false where the filter has never seen the hash."""
    shared = hashes.sparkSession.sparkContext.broadcast(words)
    rest = [c for c in hashes.columns if c != "_th"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            at = bit_places(batch["_th"].to_pylist(), len(own) * 64)
            hit = (own[(at // np.uint64(64)).astype(np.int64)] >> at % np.uint64(64)) & np.uint64(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit.all(axis=1))], [*batch.schema.names, "_maybe"])

    schema = hashes.select("_th", *rest).schema.add("_maybe", "boolean")
    return hashes.select("_th", *rest).mapInArrow(run, schema)


@dataclass
class Run:
    """What a run gives: ``rows`` (key, n_known, probabilities, reused) for each
    row with a text, and how many texts it scored itself."""
    rows: DataFrame
    n_texts: int
    n_scored: int
    n_looked_up: int


class ScoreStore:
    """The scores of one version of a model."""

    def __init__(self, spark: SparkSession, name: str, version: int, root: str | None = None, bits: int = BLOOM_BITS):
        self.spark, self.bits = spark, bits
        self.folder = f"{(root or shared_path(spark, 'scores')).rstrip('/')}/{name}/version={version}"

    def _exists(self, path: str) -> bool:
        fs, p = hadoop_path(self.spark, path)
        return fs.exists(p)

    def _claimed(self) -> list[int]:
        fs, p = hadoop_path(self.spark, self.folder)
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("batch="))

    def batches(self) -> list[int]:
        """Batches that are complete."""
        return [b for b in self._claimed() if self._exists(f"{self.folder}/batch={b}/manifest/_SUCCESS")]

    def scores(self, batches: list[int] | None = None) -> DataFrame:
        """All stored scores; a text that two runs scored at once stands in
        both their batches, with equal scores."""
        paths = [f"{self.folder}/batch={b}/scores" for b in (self.batches() if batches is None else batches)]
        return self.spark.read.schema(SCORES).parquet(*paths) if paths else self.spark.createDataFrame([], SCORES)

    def _filter(self, batches: list[int]) -> np.ndarray:
        """The batches' filters put together, bits / 8 bytes on the driver."""
        parts = [self.spark.read.schema("word long, mask long").parquet(f"{self.folder}/batch={b}/bloom") for b in batches]
        table = reduce(DataFrame.unionByName, parts).groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
        words = np.zeros(self.bits // 64, np.uint64)
        words[table["word"].to_numpy()] = table["mask"].to_numpy().view(np.uint64)
        return words

    def _write(self, scored: DataFrame) -> int:
        number = max([0, *self._claimed()]) + 1
        while True:
            fs, claim = hadoop_path(self.spark, f"{self.folder}/batch={number}/_claim")
            if fs.createNewFile(claim):
                break
            number += 1
        folder = f"{self.folder}/batch={number}"
        scored.write.mode("errorifexists").parquet(f"{folder}/scores")
        own = self.spark.read.schema(SCORES).parquet(f"{folder}/scores")
        bloom_words(own, self.bits).write.mode("errorifexists").parquet(f"{folder}/bloom")
        (own.agg(F.count(F.lit(1)).alias("n_texts"), F.lit(self.bits).alias("bits")).coalesce(1)
         .write.mode("errorifexists").parquet(f"{folder}/manifest"))
        return number

    def score(self, model: nb.NBModel, docs: DataFrame, key: str = "doc_id", text: str = "text") -> Run:
        """Scores of all rows of ``docs`` whose text is not empty; texts that no
        earlier batch holds are scored and stored as the next batch."""
        bound = broadcast_bound(self.spark)
        present = K.gate_nonempty(docs, text)
        hashes = materialize(present.select(key, F.sha2(F.col(text), 256).alias("_th")))
        texts = materialize(hashes.groupBy("_th").agg(F.min(key).alias("_rep")))
        n_texts = texts.count()
        earlier = self.batches()
        if earlier:
            asked = materialize(might_know(texts, self._filter(earlier)))
            maybe = asked.filter("_maybe").select("_th")
            n_maybe = maybe.count()
            # hashes are unique on both sides: no hot key
            known = materialize(self.scores(earlier).join(maybe, "_th").dropDuplicates(["_th"]))
            new = materialize(asked.filter(~F.col("_maybe")).select("_th", "_rep").unionByName(
                asked.filter("_maybe").join(known.select("_th"), "_th", "left_anti").select("_th", "_rep")))
        else:
            n_maybe, known, new = 0, self.scores([]), texts
        n_new = new.count()
        fresh = self.scores([])
        if n_new:
            rows, reps = present.select(key, text), new.select(F.col("_rep").alias(key))
            rows = rows.join(F.broadcast(reps) if n_new <= bound else reps, key, "left_semi")
            per_text = K.probabilities(model, rows.select(F.sha2(F.col(text), 256).alias("_th"), text), "_th", text, outer=True)
            fresh = self.scores([self._write(per_text.select("_th", F.col("n_known").cast("long").alias("n_known"), *K.PROB_COLS))])
        found = materialize(known.withColumn("reused", F.lit(True)).unionByName(fresh.withColumn("reused", F.lit(False))))
        out = checked_lookup_join(hashes, found, "_th", n_texts)
        return Run(out.select(key, "n_known", *K.PROB_COLS, "reused"), n_texts, n_new, n_maybe)
