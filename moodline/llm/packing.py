"""Lexical retrieval packing (operator 7).

Documents are tokenized once into a written table of ids, which also holds the
document frequencies of the ids (one row for each id and task). Documents are
then dealt by content over shards of bounded size, each a BM25 inverted index.
Every seed document (id divisible by 20) is a query of all its terms to every
shard, in blocks of seeds: a shard holds its documents in blocks of alike ones.
A block is passed over for a seed only if the largest weights of the seed's
terms in it, or the whole weight of a document, add up to less than the seed's
best documents so far reach; of all others the BM25 weights are added up, those
of the most frequent terms as one matrix product (which terms these are
is fitted on a bounded sample and changes no score), all others by their
postings, and the best neighbours are given. They are exact.
Over all shards a document goes to the seed that
scores it highest, so each is used once, and a seed's window is filled with its
neighbours by falling score; what does not fit is cut and opens the next
window. Documents that no seed has among its neighbours follow in the order of
their rarest ids. The ids are shuffled once, by place; text never is.
"""

from __future__ import annotations

import math
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moodline.llm import wordbpe
from moodline.llm.common import written
from moodline.operators.joins import checked_lookup_join, counted_join

WINDOW = 4096
END_ID = 2
K1, B = 1.2, 0.75
SEED_EVERY = 20
#: Expected documents of an index shard.
SHARD_DOCS = 32_768
#: Neighbours that a seed asks for; a window rarely holds more.
NEIGHBOURS = 16
#: Terms whose weights are a dense matrix (columns), and about how many
#: documents choose them. Neither changes a score.
RANK, SAMPLE_DOCS = 1024, 1000
#: Groups of alike documents in a shard, and documents of a block. Neither
#: changes a score.
GROUPS, DOC_BLOCK = 16, 512
#: Bounds of the seeds of a pass, and of those scored together.
PASS_TERMS, SEED_BLOCK = 4_000_000, 256
#: Rough scores that wait to be scored exactly.
MAX_ROUGH = 2_000_000
#: Documents tokenized or placed together.
SLICE_DOCS = 1024
#: Tokens of a packing task.
TASK_TOKENS = 8_000_000
#: Windows of a task that wait for documents to fill them.
MAX_WAITING = 1024
#: Rows of one id and text beyond this number are spread by arrival.
HOT_COPIES = 1024

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def unique_terms(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count) of the different terms of each document, by
    document, then term."""
    found = []
    for at in range(0, len(docs), 256):  # few at a time: the numbers to sort stay small
        some = docs[at:at + 256]
        both = np.concatenate(some).astype(np.int64)
        both += np.repeat(np.arange(at, at + len(some)) << 32, [len(d) for d in some])
        both.sort()
        new = np.ones(len(both), bool)
        np.not_equal(both[1:], both[:-1], out=new[1:])
        first = np.flatnonzero(new)
        found.append((both[first] >> 32, both[first] & 0xFFFFFFFF, np.diff(np.append(first, len(both)))))
    none = [(np.empty(0, np.int64),) * 3]
    return tuple(np.concatenate(x) for x in zip(*(found or none), strict=True))


def pack_terms(term: np.ndarray, count: np.ndarray, dtype: np.dtype) -> bytes:
    """Different terms, rising, then their counts (at most the type's largest
    number: BM25 is flat long before)."""
    return np.concatenate([term, np.minimum(count, np.iinfo(dtype).max)]).astype(dtype).tobytes()


def unpack_terms(raw: bytes, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(raw, dtype)
    return both[:len(both) // 2], both[len(both) // 2:]


def tokenize(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (little-endian binary, without the end id) and terms (see
    ``pack_terms``) of each document; at the end of each task a row (term, n)
    for the documents with each term, and (-1, documents) and (-2, tokens)."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("terms", pa.binary()), ("term", pa.int64()),
                        ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = wordbpe.load(path)
        df, total, n_docs = np.zeros(model.size, np.int64), 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_DOCS):
                part = batch.slice(at, SLICE_DOCS)
                ids = model.encode_many(part.column(1).to_pylist())
                owner, term, count = unique_terms([np.frombuffer(x, model.dtype) for x in ids])
                df += np.bincount(term, minlength=model.size)
                total, n_docs = total + sum(map(len, ids)) // model.dtype.itemsize, n_docs + len(ids)
                ends = np.searchsorted(owner, np.arange(len(ids) + 1)).tolist()
                terms = [pack_terms(term[a:b], count[a:b], model.dtype) for a, b in zip(ends, ends[1:])]
                nothing = pa.nulls(len(ids), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.binary()), pa.array(terms, pa.binary()), nothing, nothing], schema=schema)
        seen = np.flatnonzero(df)
        none = [pa.nulls(len(seen) + 2, t) for t in (pa.int64(), pa.binary(), pa.binary())]
        yield pa.RecordBatch.from_arrays(
            [*none, pa.array(np.append(seen, [-1, -2])), pa.array(np.append(df[seen], [n_docs, total]))], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, ids binary, terms binary, term long, n long")


def document_frequencies(tokens: DataFrame, vocabulary: int) -> tuple[np.ndarray, int, int]:
    """(documents with each id, documents, tokens); one row for each id reaches
    the driver."""
    rows = tokens.filter(F.col("term").isNotNull()).groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r["term"]: r["n"] for r in rows}
    df = np.zeros(vocabulary, np.int64)
    for i, n in found.items():
        if i >= 0:
            df[i] = n
    return df, found.get(-1, 0), found.get(-2, 0)


def rarity(df: np.ndarray) -> np.ndarray:
    """Rank of each id, the rarest that two documents have first."""
    rank = np.empty(len(df), np.int64)
    rank[np.lexsort((np.arange(len(df)), df, df < 2))] = np.arange(len(df))
    return rank


class Statistics:
    """Corpus-wide numbers of BM25; goes to every task."""

    def __init__(self, df: np.ndarray, docs: int, tokens: int) -> None:
        self.df, self.rank = df, rarity(df)
        self.idf = np.log1p((docs - df + 0.5) / (df + 0.5))
        self.mean = max(tokens / docs if docs else 0.0, 1.0)

    def weights(self, term: np.ndarray, count: np.ndarray, length: np.ndarray) -> np.ndarray:
        """BM25 weight of a term that a document of ``length`` ids has ``count`` times."""
        return self.idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * length / self.mean))


class Seeds:
    """The terms of a pass's seeds, one after the other."""

    def __init__(self, seed: np.ndarray, terms: list[np.ndarray], stats: Statistics, basis: np.ndarray) -> None:
        self.seed, self.basis = seed, basis
        self.first = np.cumsum([0] + [len(t) for t in terms])
        self.term = np.concatenate(terms) if terms else np.empty(0, np.uint16)

    def __len__(self) -> int:
        return len(self.seed)

    def pairs(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``rows``, term) of all terms of the seeds ``rows``."""
        n = self.first[rows + 1] - self.first[rows]
        at = np.repeat(self.first[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(np.arange(len(rows)), n), self.term[at]


def fit_basis(docs: list[bytes], lengths: np.ndarray, stats: Statistics, dtype: np.dtype, rank: int = RANK) -> np.ndarray:
    """The column of each term in the matrix of dense weights, or -1: the
    ``rank`` terms that most sample documents have get one, every other term is
    found by its postings. Scores are the same whichever terms these are."""
    n = np.zeros(len(stats.df), np.int64)
    for raw in docs:
        n[unpack_terms(raw, dtype)[0]] += 1
    common = np.argsort(-n, kind="stable")[:min(rank, np.count_nonzero(n))]
    basis = np.full(len(stats.df), -1, np.int32)
    basis[common] = np.arange(len(common))
    return basis


def centres(lines: np.ndarray, n: int, rounds: int = 4) -> np.ndarray:
    """Centres of ``n`` groups of alike lines (unit length each)."""
    out = lines[np.linspace(0, len(lines) - 1, min(n, len(lines))).astype(np.int64)] if len(lines) else lines
    for _ in range(rounds if len(lines) else 0):
        member = np.zeros((len(out), len(lines)), np.float32)
        member[(lines @ out.T).argmax(axis=1), np.arange(len(lines))] = 1
        sums = member @ lines
        norm = np.sqrt((sums * sums).sum(axis=1))
        out = np.where(norm[:, None] > 0, sums / np.maximum(norm, 1e-30)[:, None], out)
    return out


class ShardIndex:
    """BM25 index of a shard: forward lists, and documents in blocks of alike
    ones (groups of a dense sample, then by falling total weight). ``bound``
    has the largest weight of each term in each block."""

    def __init__(self, docs: list[bytes], lengths: np.ndarray, stats: Statistics, basis: np.ndarray, dtype: np.dtype) -> None:
        self.size, self.vocabulary = len(docs), len(stats.df)
        pairs = [unpack_terms(d, dtype) for d in docs]
        self.first = np.cumsum([0] + [len(t) for t, _ in pairs])
        self.term = np.concatenate([t for t, _ in pairs] or [np.empty(0, dtype)])
        owner = np.repeat(np.arange(self.size, dtype=np.int32), np.diff(self.first))
        count = np.concatenate([c for _, c in pairs] or [np.empty(0, dtype)])
        del pairs
        self.weight = np.empty(len(self.term))
        for at in range(0, len(self.term), 1 << 18):
            some = slice(at, at + (1 << 18))
            self.weight[some] = stats.weights(self.term[some], count[some], lengths[owner[some]])
        total = np.bincount(owner, self.weight, self.size)
        del count, owner
        self.basis, self.columns = basis, int(basis.max(initial=-1)) + 1
        lines = self._lines(np.arange(0, self.size, max(1, self.size // 2048)))
        lines /= np.maximum(np.sqrt((lines * lines).sum(axis=1)), 1e-30)[:, None]
        self.centres = centres(lines, GROUPS)
        group = np.zeros(self.size, np.int32)
        for at in range(0, self.size if len(lines) else 0, DOC_BLOCK):
            some = np.arange(at, min(at + DOC_BLOCK, self.size))
            group[some] = (self._lines(some) @ self.centres.T).argmax(axis=1)
        order = np.lexsort((-total, group))
        new = np.flatnonzero(np.diff(group[order], prepend=-1))
        cuts = [at for a, b in zip(new, [*new[1:], self.size]) for at in range(a, b, DOC_BLOCK)]
        self.blocks = [order[a:b] for a, b in zip(cuts, [*cuts[1:], self.size])]
        self.block_group = np.array([group[d[0]] for d in self.blocks], np.int32)
        self.total = total
        self.block_total = np.array([total[d[0]] for d in self.blocks], np.float32)
        self.bound = np.zeros((self.vocabulary, len(self.blocks)), np.float32)
        for i, docs_ in enumerate(self.blocks):
            _, term, weight = self._entries(docs_)
            if len(term):
                by_term = np.argsort(term, kind="stable")
                first = np.flatnonzero(np.diff(term[by_term].astype(np.int64), prepend=-1))
                self.bound[term[by_term[first]], i] = np.maximum.reduceat(weight[by_term], first)
        #: Pairs of a seed and a document that were added up so far.
        self.scored = 0

    def _entries(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``docs``, term, weight) of all terms of the documents ``docs``."""
        n = self.first[docs + 1] - self.first[docs]
        at = np.repeat(self.first[docs] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(np.arange(len(docs)), n), self.term[at], self.weight[at].astype(np.float32)

    def _lines(self, docs: np.ndarray) -> np.ndarray:
        """The weights of the terms of ``basis``, a line for each document."""
        place, term, weight = self._entries(docs)
        column = self.basis[term]
        out = np.zeros((len(docs), self.columns), np.float32)
        inside = column >= 0
        out[place[inside], column[inside]] = weight[inside]
        return out

    def _open_block(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Dense weights (column, document) of the terms of ``basis`` and which
        columns have any; places, weights and bounds of the other terms' postings."""
        place, term, weight = self._entries(docs)
        column = self.basis[term]
        inside, rest = np.flatnonzero(column >= 0), np.flatnonzero(column < 0)
        dense = np.zeros((self.columns, len(docs)), np.float32)
        dense[column[inside], place[inside]] = weight[inside]
        present = np.zeros(self.columns, bool)
        present[column[inside]] = True
        first = np.zeros(self.vocabulary + 1, np.int64)
        np.cumsum(np.bincount(term[rest], minlength=self.vocabulary), out=first[1:])
        rest = rest[np.argsort(term[rest], kind="stable")]
        return dense, present, place[rest], weight[rest], first

    def _add_up(self, seeds: Seeds, rows: np.ndarray, block: tuple, width: int) -> np.ndarray:
        """Scores of a block's first ``width`` documents, in single precision, a
        line for each of the seeds ``rows``."""
        dense, present, posting_doc, posting_weight, first = block
        row, term = seeds.pairs(rows)
        column = self.basis[term]
        inside = np.flatnonzero(column >= 0)
        asked = np.zeros(self.columns, bool)
        asked[column[inside]] = True
        asked &= present
        number = np.cumsum(asked) - 1
        inside = inside[asked[column[inside]]]
        query = np.zeros((len(rows), np.count_nonzero(asked)), np.float32)
        query[row[inside], number[column[inside]]] = 1
        out = query @ dense[np.flatnonzero(asked), :width]
        n = np.where(column < 0, first[term.astype(np.int64) + 1] - first[term], 0)
        some = np.flatnonzero(n)
        # so many at a time: a very frequent term may be found by its postings
        cuts = np.searchsorted(np.cumsum(n[some]), np.arange(0, n.sum(), 1 << 20)).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(some)]):
            part, size = some[a:b], n[some[a:b]]
            at = np.repeat(first[term[part]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            doc, line = posting_doc[at], np.repeat(row[part], size)
            near = doc < width
            out += np.bincount(line[near] * width + doc[near], posting_weight[at[near]],
                               out.size).reshape(out.shape).astype(np.float32)
        self.scored += out.size
        return out

    def _bounds(self, seeds: Seeds, rows: np.ndarray) -> np.ndarray:
        """No document of a block (column) scores more for a seed (line) than this."""
        out = np.zeros((len(rows), len(self.blocks)), np.float32)
        ends = np.cumsum(seeds.first[rows + 1] - seeds.first[rows])
        cuts = np.searchsorted(ends, np.arange(0, ends.max(initial=0), 1 << 16)).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(rows)]):
            row, term = seeds.pairs(rows[a:b])
            first = np.flatnonzero(np.diff(row, prepend=-1))
            if len(first):
                out[a + row[first]] = np.add.reduceat(self.bound[term], first, axis=0)
        return np.minimum(out, self.block_total)

    def _exact(self, seeds: Seeds, row: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Scores in double precision; ``row`` rises."""
        asked, out = np.zeros(self.vocabulary), np.empty(len(row))
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        for a, b in zip(starts, [*starts[1:], len(row)]):
            own = seeds.term[seeds.first[row[a]]:seeds.first[row[a] + 1]]
            asked[own] = 1
            out[a:b] = [self.weight[x:y] @ asked[self.term[x:y]] for x, y in
                        zip(self.first[doc[a:b]].tolist(), self.first[doc[a:b] + 1].tolist(), strict=True)]
            asked[own] = 0
        return out

    def neighbours(self, seeds: Seeds, key: np.ndarray, wanted: float, k: int,
                   least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(seed, document, score) of the ``k`` best neighbours of each seed
        among all documents of the shard. A block is passed over for a seed only
        if the bounds of its terms, or of its documents, add up to less than
        ``wanted`` (at least ``k``) documents already reach, or than ``least`` of
        the seed, rounding included; else all its documents are scored by all
        terms in single precision, and those that may be among the best again
        in double precision. ``key`` names the documents as ``seeds.seed`` does
        the seeds; a seed is not its own neighbour. Ties go to the smaller key."""
        wanted, size = max(round(wanted), k), np.diff(seeds.first)
        error = (size + 16) * 2.0 ** -23  # sums of ``size`` weights, none negative
        reached = np.zeros((len(seeds), wanted), np.float32)
        floor = np.zeros(len(seeds)) if least is None else least * (1 - 2 * error)
        group = np.full(len(seeds), -1)
        for at in range(0, len(seeds) if len(self.centres) else 0, SEED_BLOCK):
            some = np.arange(at, min(at + SEED_BLOCK, len(seeds)))
            row, term = seeds.pairs(some)
            column = self.basis[term]
            query = np.zeros((len(some), self.columns), np.float32)
            query[row[column >= 0], column[column >= 0]] = 1
            group[some] = (query @ self.centres.T).argmax(axis=1)
        order = np.lexsort((size, group))
        order = order[size[order] > 0]
        bounds = np.zeros((len(seeds), len(self.blocks)))
        bounds[order] = self._bounds(seeds, order) * (1 + 4 * error[order])[:, None]
        # which seed a document is itself
        by_key = np.argsort(seeds.seed, kind="stable")
        at = np.minimum(np.searchsorted(seeds.seed[by_key], key), max(len(seeds) - 1, 0))
        itself = np.where(seeds.seed[by_key[at]] == key, by_key[at], -1) if len(seeds) else np.full(len(key), -1)
        place = np.full(len(seeds) + 1, -1)  # of a seed in the block of seeds; the last one is nobody's
        found = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        waiting, n_waiting = [], 0

        def settle() -> None:
            nonlocal found, waiting, n_waiting
            if not waiting:
                return
            row, doc, rough = (np.concatenate(x) for x in zip(*waiting, strict=True))
            some = np.flatnonzero(rough >= floor[row])
            some = some[np.argsort(row[some], kind="stable")]
            row, doc = row[some], doc[some]
            row, doc, score = (np.concatenate(x) for x in
                               zip(found, (row, doc, self._exact(seeds, row, doc)), strict=True))
            best = np.lexsort((key[doc], -score, row))
            best = best[np.arange(len(best)) - np.searchsorted(row[best], row[best]) < k]
            best = best[score[best] > 0]
            found, waiting, n_waiting = (row[best], doc[best], score[best]), [], 0

        for alike in (True, False):
            for i, every in enumerate(self.blocks):
                todo = order[(group[order] == self.block_group[i]) == alike]
                todo = todo[bounds[todo, i] >= floor[todo]]
                todo = todo[np.lexsort((-floor[todo], group[todo]))]
                block, falling_total = self._open_block(every) if len(todo) else None, -self.total[every]
                for at in range(0, len(todo), SEED_BLOCK):
                    rows = todo[at:at + SEED_BLOCK]
                    # a document scores no more than all its weights together
                    width = np.searchsorted(falling_total, -(floor[rows] * (1 - 4 * error[rows])).min(), "right")
                    docs = every[:width]
                    if not len(docs):
                        continue
                    lines = self._add_up(seeds, rows, block, width)
                    place[rows] = np.arange(len(rows))
                    own = place[itself[docs]]
                    lines[own[own >= 0], np.flatnonzero(own >= 0)] = 0
                    place[rows] = -1
                    hit = (lines >= floor[rows, None]) & (lines > 0)
                    if np.count_nonzero(hit) > 2 * wanted * len(rows) and wanted < len(docs):
                        nth = np.partition(lines, len(docs) - wanted, axis=1)[:, len(docs) - wanted]
                        floor[rows] = np.maximum(floor[rows], nth * (1 - 2 * error[rows]))
                        hit = (lines >= floor[rows, None]) & (lines > 0)
                    row, doc = np.nonzero(hit)
                    if not len(row):
                        continue
                    rough = lines[row, doc]
                    # the best so far of the seeds with any
                    falling = np.lexsort((-rough, row))
                    nth = np.arange(len(row)) - np.searchsorted(row, row)
                    some, number = np.unique(row, return_inverse=True)
                    new = np.zeros((len(some), wanted), np.float32)
                    new[number[nth < wanted], nth[nth < wanted]] = rough[falling][nth < wanted]
                    both = np.concatenate([reached[rows[some]], new], axis=1)
                    reached[rows[some]] = np.partition(both, wanted, axis=1)[:, wanted:]
                    least_now = reached[rows[some]].min(axis=1) * (1 - 2 * error[rows[some]])
                    floor[rows[some]] = np.maximum(floor[rows[some]], least_now)
                    still = rough >= floor[rows[row]]
                    waiting.append((rows[row[still]], docs[doc[still]], rough[still]))
                    n_waiting += np.count_nonzero(still)
                    if n_waiting > MAX_ROUGH:
                        settle()
        settle()
        return found


def hot_copies(tokens: DataFrame) -> tuple[DataFrame, int]:
    """(key, hot) of the rows that occur very often, and how many those are."""
    hot = written(tokens.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > HOT_COPIES)
                  .select("key", F.lit(True).alias("hot")))
    return hot, hot.count()


def with_hot(rows: DataFrame, hot: DataFrame, n_hot: int) -> DataFrame:
    if not n_hot:
        return rows.withColumn("hot", F.lit(False))
    joined = checked_lookup_join(rows, hot, "key", n_hot, how="left")
    return joined.withColumn("hot", F.coalesce("hot", F.lit(False)))


def _deal(tokens: DataFrame, shards: int, hot: DataFrame, n_hot: int) -> DataFrame:
    """shard, key, length, terms in shards of the keys' hash, sorted. Of rows
    that share a key one is enough: what has very many copies is reduced
    beforehand. A task reads several shards one after the other and gives one
    list for each seed, so the lists to merge grow with the root of the shards."""
    rows = tokens.select("key", "length", "terms")
    if n_hot:
        marked = with_hot(rows, hot, n_hot)
        rows = marked.filter(~F.col("hot")).unionByName(marked.filter("hot").dropDuplicates(["key"])).drop("hot")
    shard = F.pmod("key", F.lit(shards)).alias("shard")
    tasks = -(-3 * math.isqrt(4 * shards) // 4)
    return (rows.select(shard, "key", "length", "terms").repartition(tasks, F.pmod("shard", F.lit(tasks)))
            .sortWithinPartitions("shard", "key"))


def find_neighbours(tokens: DataFrame, stats: Statistics, dtype: np.dtype, docs: int, hot: tuple[DataFrame, int],
                    seed_every: int = SEED_EVERY, shard_docs: int = SHARD_DOCS, k: int = NEIGHBOURS) -> DataFrame:
    """seed, key, score: exactly the ``k`` best neighbours of each seed by BM25
    over all documents; work is seeds times documents, a shard at a time. Rows with equal id and ids share a key (``key`` of
    ``tokens``) and are one document here. Written."""
    shards = max(1, -(-docs // shard_docs))
    dealt = _deal(tokens, shards, *hot)

    all_seeds = written(tokens.filter(F.col("doc_id") % seed_every == 0).select(
        F.col("key").alias("seed"), "terms").dropDuplicates(["seed"]))
    n_terms = (all_seeds.agg(F.sum(F.octet_length("terms"))).first()[0] or 0) // (2 * dtype.itemsize)
    passes = max(1, -(-n_terms // PASS_TERMS))
    share = max(1, -(-docs // SAMPLE_DOCS))
    # only to choose the dense terms: no score depends on it
    sample = (tokens.filter(F.pmod(F.hash("key"), F.lit(share)) == 0).select("key", "length", "terms")
              .limit(4 * SAMPLE_DOCS).toArrow())
    basis = fit_basis(sample["terms"].to_pylist(), sample["length"].to_numpy(), stats, dtype)

    def one_pass(number: int) -> DataFrame:
        mine = all_seeds.filter(F.pmod(F.hash("seed"), F.lit(passes)) == number) if passes > 1 else all_seeds
        table = mine.orderBy("seed").toArrow()
        seeds = Seeds(table["seed"].to_numpy(), [unpack_terms(x, dtype)[0] for x in table["terms"].to_pylist()],
                      stats, basis)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wordbpe.load.cache_clear()  # the worker's memo of words is not needed any more
            found = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

            def search(keys: list[int], lengths: list[int], terms: list[bytes]) -> None:
                nonlocal found
                index, key = ShardIndex(terms, np.array(lengths, np.int64), stats, basis, dtype), np.array(keys, np.int64)
                # the k-th best of the shards before is the least that counts
                nth = np.searchsorted(found[0], np.arange(len(seeds))) + k - 1
                full = np.flatnonzero(nth < np.searchsorted(found[0], np.arange(len(seeds)), "right"))
                least = np.zeros(len(seeds))
                least[full] = found[2][nth[full]]
                seed, doc, score = index.neighbours(seeds, key, k, k, least)
                seed, doc, score = (np.concatenate(x) for x in zip(found, (seed, key[doc], score), strict=True))
                order = np.lexsort((doc, -score, seed))
                order = order[np.arange(len(order)) - np.searchsorted(seed[order], seed[order]) < k]
                found = seed[order], doc[order], score[order]

            now, keys, lengths, terms = None, [], [], []
            for batch in batches:
                for shard, key, length, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    if shard != now and keys:
                        search(keys, lengths, terms)
                        keys, lengths, terms = [], [], []
                    now = shard
                    if not keys or key != keys[-1]:
                        keys.append(key)
                        lengths.append(length)
                        terms.append(raw)
            if keys:
                search(keys, lengths, terms)
            for at in range(0, len(found[0]), 1 << 16):
                seed, key, score = (x[at:at + (1 << 16)] for x in found)
                yield pa.RecordBatch.from_arrays([pa.array(seeds.seed[seed]), pa.array(key), pa.array(score)],
                                                 ["seed", "key", "score"])

        best = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("score"), "key"))
        found = dealt.mapInArrow(run, "seed long, key long, score double")
        return written(found.withColumn("_r", best).filter(F.col("_r") <= k).select("seed", "key", "score"))

    out = one_pass(0)
    for number in range(1, passes):
        out = out.unionByName(one_pass(number))
    return out


def assign(tokens: DataFrame, neighbours: DataFrame, seed_every: int = SEED_EVERY) -> DataFrame:
    """key, cluster, score: each neighbour is used once, by the seed that scores
    it highest (the smaller key among equals). A seed is used by itself, before
    its neighbours."""
    seeds = tokens.filter(F.col("doc_id") % seed_every == 0).select(
        "key", F.col("key").alias("cluster"), F.lit(float("inf")).alias("score"))
    used = seeds.unionByName(neighbours.select("key", F.col("seed").alias("cluster"), "score"))
    best = F.max_by(F.struct("cluster", "score"), F.struct(F.col("score"), F.bitwise_not(F.col("cluster"))))
    return used.groupBy("key").agg(best.alias("_b")).select("key", "_b.cluster", "_b.score")


class Packer:
    """Windows of one task; pieces are collected column by column. A seed opens
    a window; what its neighbours leave free waits for the other documents."""

    def __init__(self, split: int, window: int) -> None:
        self.window, self.next_id = window, split << 32
        self.open: list[tuple] = []  # pieces of the open window
        self.filled = 0
        self.waiting: deque[tuple[list[tuple], int]] = deque()
        self.rows: list[tuple] = []

    def open_window(self) -> None:
        """Let the open window wait and begin another one."""
        if self.filled:
            self.waiting.append((self.open, self.filled))
            self.open, self.filled = self.waiting.popleft() if len(self.waiting) > MAX_WAITING else ([], 0)

    def add(self, doc_id: int | None, ids: np.ndarray, fill: bool = False, start: int = 0, size: int | None = None) -> None:
        """Put ids into the open window and those after it; ``fill``: into
        windows that wait, as long as there are any."""
        at, size = 0, len(ids) if size is None else size
        while at < len(ids):
            if fill and not self.filled and self.waiting:
                self.open, self.filled = self.waiting.popleft()
            take = min(len(ids) - at, self.window - self.filled)
            self.open.append((doc_id, start + at, ids[at:at + take], size))
            self.filled += take
            at += take
            if self.filled == self.window:
                self._close(self.open)
                self.open, self.filled = [], 0

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, size in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), size,
                              self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def finish(self) -> None:
        """Fill the windows that wait from one another, and cut what is then
        left into sequences of power-of-two length."""
        while self.waiting:
            for doc_id, start, ids, size in self.waiting.pop()[0]:
                self.add(doc_id, ids, True, start, size)
        left, pieces = self.filled, self.open
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            cut, rest = [], []
            for doc_id, start, ids, size in pieces:
                take = min(room, len(ids))
                room -= take
                if take:
                    cut.append((doc_id, start, ids[:take], size))
                if take < len(ids):
                    rest.append((doc_id, start + take, ids[take:], size))
            self._close(cut)
            pieces = rest
        self.open, self.filled = [], 0

    def drain(self) -> pa.RecordBatch:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        cols = list(zip(*self.rows, strict=True)) if self.rows else [[] for _ in names]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)


def _rarest(docs: list[bytes], stats: Statistics, dtype: np.dtype) -> np.ndarray:
    """Ranks of the three rarest ids that another document has too, rarest
    first, of each document; the vocabulary's size where there is none."""
    none = len(stats.df)
    rank = np.where(stats.df > 1, stats.rank, none)
    out = np.full((len(docs), 3), none, np.int64)
    for i, raw in enumerate(docs):
        own = rank[unpack_terms(raw, dtype)[0]]
        first = np.sort(np.partition(own, 2)[:3]) if len(own) > 3 else np.sort(own)
        out[i, :len(first)] = first
    return out


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id",
         text_col: str = "text", seed_every: int = SEED_EVERY, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id (unique), offset. Every id of every document, end id included,
    lies in exactly one piece. The rows do not depend on the order or the
    partitions in which the documents arrive.

    A null or empty text is its end id alone; a text longer than a window fills
    several. Documents with equal scores go by their key, a hash of id and ids.
    Repeated rows are packed each for itself. A row without an id is no seed.
    An empty table gives no row; other columns are not read, whatever their
    names."""
    model = wordbpe.load(path)
    dtype = model.dtype
    table = written(tokenize(docs, path, id_col, text_col).withColumn("key", F.xxhash64("doc_id", "ids")))
    df, n_docs, n_tokens = document_frequencies(table, model.size)
    stats = Statistics(df, n_docs, n_tokens)
    tokens = table.filter(F.col("ids").isNotNull()).select(
        "doc_id", "ids", "terms", "key", (F.octet_length("ids") / dtype.itemsize).cast("long").alias("length"))
    hot = hot_copies(tokens)
    found = find_neighbours(tokens, stats, dtype, n_docs, hot, seed_every, shard_docs)
    used = written(assign(tokens, found, seed_every))

    tasks = max(1, -(-(n_tokens + n_docs) // TASK_TOKENS))
    # a rarest id of many documents is spread over several groups
    rank_df = np.zeros(len(df) + 1, np.int64)
    rank_df[stats.rank] = df
    rank_df[-1] = n_docs
    parts = 1 + rank_df * (int(stats.mean) + 1) * 8 // TASK_TOKENS

    @F.pandas_udf("cluster long, part long, tie long")
    def by_rarest(terms, key, copy):
        """Where a document goes that no seed uses."""
        import pandas as pd
        rare = _rarest(list(terms), stats, dtype)
        part = (key.to_numpy() + copy.to_numpy()) % parts[rare[:, 0]]
        return pd.DataFrame({"cluster": rare[:, 0], "part": part, "tie": rare[:, 1] << 32 | rare[:, 2]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wordbpe.load.cache_clear()
        packer, now = Packer(TaskContext.get().partitionId(), window), None
        for batch in batches:
            for doc_id, raw, kind, cluster in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(),
                                                  batch.column(3).to_pylist(), strict=True):
                if kind == 0 and cluster != now:
                    packer.open_window()
                    now = cluster
                ids = np.append(np.frombuffer(raw.as_buffer(), dtype), dtype.type(end_id))
                packer.add(doc_id, ids, fill=kind == 1)
            yield packer.drain()
        packer.finish()
        yield packer.drain()

    # rows of one id and text are alike: the very many are spread by arrival
    joined = with_hot(counted_join(tokens, used, "key", how="left"), *hot)
    free = F.col("cluster").isNull() | F.col("hot")
    copy = F.when(F.col("hot"), F.monotonically_increasing_id()).otherwise(0)
    zero = F.lit(0).cast("long")
    # the ids do not pass through Python here, only the terms do
    rows = joined.select("doc_id", "key", "ids", free.alias("free"), F.col("cluster").alias("seed"), "score",
                         by_rarest("terms", "key", copy).alias("own"))
    placed = rows.select(
        "doc_id", "key", "ids", F.col("free").cast("int").alias("kind"),
        F.when(F.col("free"), F.col("own.cluster")).otherwise(F.col("seed")).alias("cluster"),
        F.when(F.col("free"), F.col("own.part")).otherwise(zero).alias("part"),
        F.when(F.col("free"), F.lit(0.0)).otherwise(-F.col("score")).alias("place"),
        F.when(F.col("free"), F.col("own.tie")).otherwise(zero).alias("tie"))
    order = ["kind", "cluster", "part"]
    return (placed.repartition(tasks, *order).sortWithinPartitions(*order, "place", "tie", "key")
            .select("doc_id", "ids", "kind", "cluster").mapInArrow(run, SCHEMA))
