"""Subword encoding (E1, E2 with pieces instead of whole words).

The pieces are the entries of a public vocabulary file; nothing is trained. A
word is cut longest piece first, by a trie, from left to right: the piece that
ends the word is looked up among the entries marked as word ends, all others
among the unmarked ones. Single characters of the byte-level alphabet are
entries of either kind, so there is no unknown word.

Texts are encoded where they are read, in slices of bounded size; a slice looks
each different word up once, in a bounded memo.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from moodline.functions import text as T
from moodline.operators.encoding import PAD_ID, chunk_schema, chunk_slices, token_slices

#: Names of the markers in the vocabulary file.
START, END, WORD_END = "<|startoftext|>", "<|endoftext|>", "</w>"
#: Words that a worker remembers.
MEMO_WORDS = 200_000


def byte_alphabet() -> list[str]:
    """The character of each byte: printable ones stand for themselves, the
    others for the characters from U+0100 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Trie:
    """Longest entry that starts at a place of a word."""

    def __init__(self, entries: dict[str, int]) -> None:
        self.root: dict = {}
        for entry, i in entries.items():
            node = self.root
            for c in entry:
                node = node.setdefault(c, {})
            node[""] = i

    def longest(self, word: str, at: int, end: int) -> tuple[int, int]:
        """(where the longest entry inside word[at:end] ends, its id); (at, -1) if there is none."""
        node, found, number = self.root, at, -1
        for i in range(at, end):
            node = node.get(word[i])
            if node is None:
                break
            if "" in node:
                found, number = i + 1, node[""]
        return found, number

    def get(self, word: str, at: int) -> int | None:
        """The id of the entry that is exactly word[at:]."""
        node = self.root
        for i in range(at, len(word)):
            node = node.get(word[i])
            if node is None:
                return None
        return node.get("")


class Pieces:
    """The entries of a vocabulary file (JSON, model.vocab: piece -> id)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        vocab = dict(content["model"]["vocab"])
        added = {t["content"]: t["id"] for t in content.get("added_tokens", [])}
        self.start, self.end = ({**vocab, **added}[m] for m in (START, END))
        plain = {p: i for p, i in vocab.items() if p not in added}
        self.inner = Trie({p: i for p, i in plain.items() if not p.endswith(WORD_END)})
        self.last = Trie({p.removesuffix(WORD_END): i for p, i in plain.items() if p.endswith(WORD_END)})
        self.longest = max((len(p.removesuffix(WORD_END)) for p in plain), default=1)
        self.alphabet = byte_alphabet()
        self._memo: dict[str, np.ndarray] = {}

    def cut(self, word: str) -> list[int]:
        """Ids of a word's pieces, longest first from the left. A piece that
        reaches the end is one of those marked as word ends, if there is one
        as long as the rest; its inner form never ends a word."""
        chars = "".join([self.alphabet[b] for b in word.encode()])
        out, at = [], 0
        while at < len(chars):
            if len(chars) - at <= self.longest:
                whole = self.last.get(chars, at)
                if whole is not None:
                    out.append(whole)
                    return out
            # the last character is left for a marked piece
            at, number = self.inner.longest(chars, at, len(chars) - 1)
            if number < 0:
                raise ValueError(f"the vocabulary has no piece for {chars[at:at + 10]!r}")
            out.append(number)
        return out

    def encode(self, words: list[str]) -> list[np.ndarray]:
        if len(self._memo) > MEMO_WORDS:
            self._memo.clear()
        for w in words:
            if w not in self._memo:
                self._memo[w] = np.array(self.cut(w), np.int64)
        return [self._memo[w] for w in words]


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


def encode_subwords(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, chunk, n_tokens (pieces of the whole text), input_ids,
    attention_mask: like ``encoding.encode``, with pieces. No row for a text
    without words. ``path``: a vocabulary file that every worker can read."""
    toks = docs.select(key, T.tokens(F.col(text)).alias("_toks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        for batch in batches:
            for keys, lists in token_slices(batch):
                words = lists.flatten().dictionary_encode()
                ids = pieces.encode(words.dictionary.to_pylist())
                sizes = np.array([len(x) for x in ids], np.int64)
                pool = np.concatenate(ids) if ids else np.empty(0, np.int64)
                at = words.indices.to_numpy()
                n = sizes[at]
                ends = np.concatenate([[0], np.cumsum(n)])
                flat = pool[np.repeat((np.cumsum(sizes) - sizes)[at] - ends[:-1], n) + np.arange(ends[-1])]
                per_text = np.diff(ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()])
                yield from chunk_slices(keys, per_text, flat, key, pieces.start, pieces.end, PAD_ID)

    return toks.mapInArrow(run, chunk_schema(Ty.StructField(key, docs.schema[key].dataType)))
