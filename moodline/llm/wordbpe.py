"""Ids of a word-level BPE tokenizer file of the ``tokenizers`` library, with a
bounded memo of words. A text is cut only where the tokenizer itself never
joins characters, and every part is encoded by the library once. The words of a
whole slice of texts are looked up once for each distinct word."""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bound of the memo, two generations of half as many words and parts (and one
#: slice's).
MEMO_PARTS = 600_000
#: Texts are encoded together up to so many characters; longer ones in pieces.
SLICE_CHARS = 1 << 22
_SPACE = re.compile(r"[\t\n\x0b\x0c\r ]")
_PLAIN_PARTS = re.compile(r"[a-zß-öø-ɏ]+|[0-9]|[!-/:-`{-~]+")
#: Texts of ASCII (no apostrophe, no control character but white space) and
#: precomposed Latin letters: there the tokenizer's own split is a letter run,
#: one digit or a run of other characters, and lower-casing keeps the text NFC.
#: Capitals whose small letter lies outside the parts (U+018F -> U+0259) are
#: left to the library.
_LATIN = "".join(c for c in map(chr, range(0xC0, 0x250)) if _PLAIN_PARTS.fullmatch(c.lower()))
_PLAIN = re.compile(rf"[\t\n\x0b\x0c\r -&(-~{_LATIN}]*")

#: Kind of each byte of a lower-cased plain text: white space, a letter (all
#: bytes of non-ASCII ones), a digit, anything else.
_SPACES, _LETTER, _DIGIT, _OTHER = range(4)
_KINDS = np.array([_SPACES if b in b" \t\n\x0b\x0c\r" else _LETTER if b >= 128 or 97 <= b <= 122
                   else _DIGIT if 48 <= b <= 57 else _OTHER for b in range(256)], np.uint8)


#: Plain words up to so many bytes are kept as numbers, longer ones as strings.
WORD_BYTES = 32
_BELOW = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _numbers(words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the first ``WORD_BYTES`` bytes as numbers, a hash of them, length) of
    each word, without a Python object for any. No plain word has a zero byte,
    so words that fit are told apart by their numbers."""
    first = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    size = np.diff(first)
    blob = bytes(words.buffers()[2] or b"") + bytes(WORD_BYTES + 8)
    any8 = np.ndarray((len(blob) - 7,), "<u8", blob, strides=(1,))
    parts = np.empty((len(words), WORD_BYTES // 8), np.uint64)
    for i in range(parts.shape[1]):
        parts[:, i] = any8[first[:-1] + np.minimum(8 * i, size)] & _BELOW[np.clip(size - 8 * i, 0, 8)]
    mixed = (parts * _MIX).sum(axis=1, dtype=np.uint64)
    return parts, (mixed ^ (mixed >> np.uint64(29))) * _MIX[1], size


class _Words:
    """Ids of words: columns sorted by hash, and the ids one after the other."""

    def __init__(self, dtype: np.dtype) -> None:
        self.hash, self.parts = np.empty(0, np.uint64), np.empty((0, WORD_BYTES // 8), np.uint64)
        self.start, self.size, self.pool = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, dtype)

    def __len__(self) -> int:
        return len(self.hash)

    def find(self, hash_: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """The place of each word, or -1."""
        if not len(self):
            return np.full(len(hash_), -1)
        by_hash = np.argsort(hash_)  # neighbouring searches touch neighbouring memory
        at = np.empty(len(hash_), np.int64)
        at[by_hash] = np.searchsorted(self.hash, hash_[by_hash])
        at[at == len(self)] = 0
        return np.where((self.parts[at] == parts).all(axis=1), at, -1)

    def add(self, hash_: np.ndarray, parts: np.ndarray, size: np.ndarray, pool: np.ndarray) -> None:
        """Words that are not there yet; of those that share a hash one is kept."""
        hash_ = np.concatenate([self.hash, hash_])
        order = np.argsort(hash_, kind="stable")
        order = order[np.diff(hash_[order], prepend=~hash_[order[:1]]) != 0]
        self.hash, self.parts = hash_[order], np.concatenate([self.parts, parts])[order]
        self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(size) - size])[order]
        self.size, self.pool = np.concatenate([self.size, size])[order], np.concatenate([self.pool, pool])


def _gather(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of runs that begin at ``start``, one run after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


class WordBpe:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one task a core
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(path)
        self.size = self.lib.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self._memo: dict = {}
        self._old: dict = {}
        self._bpe = self.lib.model
        self._code = "H" if self.dtype.itemsize == 2 else "I"
        # the byte-level alphabet: printable bytes stand for themselves, the
        # others for the characters from U+0100 on, in order
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = iter(range(256, 512))
        self._byte_chars = {b: chr(b) if b in printable else chr(next(others)) for b in range(256)}
        self._words, self._old_words = _Words(self.dtype), _Words(self.dtype)

    def _fill(self, parts: set) -> None:
        """Put ``parts`` into the memo, from the generation before or anew."""
        chunks = []
        for p in parts:
            known = self._old.get(p)
            if known is not None:
                self._memo[p] = known
            elif isinstance(p, str) and p.isspace():
                self._memo[p] = b""
            elif isinstance(p, str):
                self._memo[p] = array(self._code, self._plain(p)).tobytes()
            else:
                chunks.append(p)
        for part, ids in zip(chunks, self._ids([c.decode() for c in chunks]), strict=True):
            self._memo[part] = np.array(ids, self.dtype).tobytes()

    def _plain(self, part: str) -> list[int]:
        """Ids of a plain part: it is one pre-token, so the model alone encodes it."""
        word = part if part.isascii() else part.encode().decode("latin-1").translate(self._byte_chars)
        return [t.id for t in self._bpe.tokenize(word)]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, text: str | None) -> bytes:
        """Ids of ``text`` as little-endian integers of ``dtype``."""
        if not text:
            return b""
        if _PLAIN.fullmatch(text) and "<|" not in text:
            parts = _PLAIN_PARTS.findall(text.lower())
        else:
            # white space always separates; bytes.split() splits on ASCII's
            parts = text.encode().split()
        self._turn()
        missing = set(parts).difference(self._memo)
        if missing:
            self._fill(missing)
        return b"".join(map(self._memo.__getitem__, parts))

    def _turn(self) -> None:
        if len(self._memo) > MEMO_PARTS // 2:
            self._old, self._memo = self._memo, {}
        if len(self._words) > MEMO_PARTS // 2:
            self._old_words, self._words = self._words, _Words(self.dtype)

    def _look_up(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, size, ids): the ids of each of different words. Only words
        that are not known yet, and long ones, become Python strings."""
        self._turn()
        parts, hash_, length = _numbers(words)
        at = self._words.find(hash_, parts)
        at[length > WORD_BYTES] = -1
        start, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        known = at >= 0
        start[known], size[known] = self._words.start[at[known]], self._words.size[at[known]]
        # words of the generation before, then new ones
        missing = np.flatnonzero(~known)
        at = self._old_words.find(hash_[missing], parts[missing])
        at[length[missing] > WORD_BYTES] = -1
        again, at, missing = missing[at >= 0], at[at >= 0], missing[at < 0]
        size[again] = self._old_words.size[at]
        pools = [self._words.pool, self._old_words.pool[_gather(self._old_words.start[at], size[again])]]
        new, ends = [], []
        for text in words.take(pa.array(missing)).to_pylist():
            new += self._plain(text)
            ends.append(len(new))
        size[missing] = np.diff(np.array(ends, np.int64), prepend=0)
        pools.append(np.array(new, self.dtype))
        fresh = np.concatenate([again, missing])
        start[fresh] = len(pools[0]) + np.cumsum(size[fresh]) - size[fresh]
        pool = np.concatenate(pools)
        short = fresh[length[fresh] <= WORD_BYTES]
        self._words.add(hash_[short], parts[short], size[short], pool[_gather(start[short], size[short])])
        return start, size, pool

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """``encode`` of every text; texts that are cut at white space and into
        plain parts are looked up together."""
        out = [b""] * len(texts)
        some, places, size = [], [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if not _PLAIN.fullmatch(text) or "<|" in text:
                out[i] = self.encode(text)
                continue
            low = text.lower()
            if len(low) > SLICE_CHARS:
                out[i] = b"".join(self._encode_plain([p])[0] for p in _pieces(low))
                continue
            some.append(low)
            places.append(i)
            size += len(low)
            if size > SLICE_CHARS:
                for j, ids in zip(places, self._encode_plain(some), strict=True):
                    out[j] = ids
                some, places, size = [], [], 0
        for j, ids in zip(places, self._encode_plain(some) if some else [], strict=True):
            out[j] = ids
        return out

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        """Ids of lower-cased plain texts: runs of one kind of character, white
        space left out, are looked up once for each different run and gathered
        by their numbers."""
        encoded = [t.encode() for t in texts]
        raw = np.frombuffer(b" ".join(encoded), np.uint8)
        kind = _KINDS[raw]
        new = np.empty(len(raw), bool)
        new[0] = True
        np.not_equal(kind[1:], kind[:-1], out=new[1:])
        new |= kind == _DIGIT
        kept = kind != _SPACES
        first = np.cumsum([0] + [len(e) + 1 for e in encoded[:-1]])
        n_kept = np.add.reduceat(kept, first, dtype=np.int64)
        starts = np.flatnonzero(new[kept])
        blob = raw[kept]
        del kind, new, kept
        runs = pa.LargeStringArray.from_buffers(
            len(starts), pa.py_buffer(np.append(starts, len(blob))), pa.py_buffer(blob)).dictionary_encode()
        at = runs.indices.to_numpy()
        start, sizes, pool = self._look_up(runs.dictionary)
        n = sizes[at]
        ends = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=ends[1:])
        # places in the pool; a slice and the memo have far fewer than 2^31 ids
        from_pool = np.repeat((start[at] - ends[:-1]).astype(np.int32), n)
        from_pool += np.arange(len(from_pool), dtype=np.int32)
        flat = pool[from_pool]
        bounds = ends[np.searchsorted(starts, np.append(0, np.cumsum(n_kept)))].tolist()
        return [flat[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]


def _pieces(text: str) -> list[str]:
    """A long text cut before white space."""
    out, at = [], 0
    while at < len(text):
        found = _SPACE.search(text, at + SLICE_CHARS)
        end = found.start() if found else len(text)
        out.append(text[at:end])
        at = end
    return out


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)
