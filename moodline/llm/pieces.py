"""SentencePiece (BPE model) encoding and decoding (operator 5).

Encoding fills a table of merge-type prefixes: the encoding of each prefix of
a text ends in exactly one token, and a token sequence is the encoding of its
text if and only if each pair of neighbours is compatible (merging the two
tokens' text alone gives just these two). So for every position the tokens
that end there (Aho-Corasick matches) are tried against the last token of the
prefix before them; the one that fits is that prefix's last token. Ids are
recovered backwards from the end of the text.

No token crosses a place whose two characters stand side by side in no piece.
If the model's pieces never mix letters with other characters (word marks in
front aside), texts are cut there and encoded part by part with a bounded memo.
The model file is loaded once per Python worker; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import lru_cache
from hashlib import sha256
from itertools import chain, pairwise

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodline.llm.common import map_rows

MARK = "▁"
#: Bounds of the per-worker memos (entries); a full memo is emptied.
MEMO_PAIRS = 400_000
MEMO_PARTS = 600_000
MEMO_PART_CHARS = 32
#: Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class _Memo(dict):
    """Ids of parts met before. When full it becomes the old generation, from
    which parts that are met again are taken over."""

    def __init__(self, find: Callable[[str], tuple[int, ...]]) -> None:
        super().__init__()
        self.find, self.old = find, {}

    def __missing__(self, part: str) -> tuple[int, ...]:
        ids = self.old.get(part)
        if ids is None:
            ids = self.find(part)
        if len(part) <= MEMO_PART_CHARS:
            if len(self) >= MEMO_PARTS // 2:
                self.old = dict(self)
                self.clear()
            self[part] = ids
        return ids


class PieceModel:
    """Encoder and decoder of one BPE model file with identity normalisation."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb
        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        kinds = {p.type for p in proto.pieces}
        if (proto.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces
                or not norm.escape_whitespaces or not proto.trainer_spec.byte_fallback
                or kinds & {USER_DEFINED, UNUSED}):
            raise ValueError("not a byte-fallback BPE model with identity normalisation")
        self.dummy_prefix = norm.add_dummy_prefix
        self.texts = [p.piece for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.scores = [p.score for p in proto.pieces]
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        # classes that no piece mixes: letters, digits, all else; the underscore
        # and numbers such as superscripts are word characters for ``re``, so
        # the few texts that hold them take a slower pattern
        odd = "_" + "".join(c for c in self.ids
                            if len(c) == 1 and c.isalnum() and not c.isalpha() and not c.isdecimal())
        letter, other = rf"[^\W\d{odd}]", rf"(?:[^\w{MARK}]|[{odd}])"
        mixed = re.compile(rf"[^{MARK}]{MARK}|{letter}{other}|{other}{letter}|[^{MARK}]\d|\d.", re.S)
        self.by_part = not any(mixed.match(a + b) for p in self.ids for a, b in pairwise(p))
        self._odd = re.compile(f"[{odd}]")
        self._parts = re.compile(rf"{MARK}*{letter}+|{MARK}*{other}+|{MARK}*\d+|{MARK}+")
        self._plain_parts = re.compile(rf"{MARK}?[^\W\d]+|{MARK}*[^\w{MARK}]+|{MARK}*\d+|{MARK}+[^\W\d]*")
        if any(c not in self.ids for p in self.ids for c in p):
            raise ValueError("a character of a piece is no piece itself")
        self._auto = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self._auto.add_word(piece, (i, len(piece)))
        self._auto.make_automaton()
        self._pairs: dict[int, bool] = {}
        self._memo = _Memo(self._part_ids)
        self._id_text = [str(i) for i in range(len(self.texts))]
        # what an id shows when decoded; bytes from 128 on are put together apart
        self._shown = [p.replace(MARK, " ") if k == NORMAL else " ⁇ " if k == UNKNOWN else
                       chr(self.byte_of[i]) if k == BYTE and self.byte_of[i] < 128 else ""
                       for i, (p, k) in enumerate(zip(self.texts, self.kinds, strict=True))]
        self._high = frozenset(i for i, b in self.byte_of.items() if b >= 128)

    # -- encoding --------------------------------------------------------

    def merge(self, text: str) -> list[str]:
        """Plain BPE of a short text: the best-scored neighbour pair, the
        leftmost of equals, is joined until no joined pair is a piece."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                piece = self.ids.get(parts[i] + parts[i + 1])
                if piece is not None and (best is None or self.scores[piece] > best):
                    best, at = self.scores[piece], i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether the pieces ``left`` and ``right`` stay as they are side by
        side; a ``left`` of -1 asks the same of ``right`` alone."""
        if len(self._pairs) >= MEMO_PAIRS:
            self._pairs.clear()
        alone = [] if left < 0 else [self.texts[left]]
        both = [*alone, self.texts[right]]
        known = self._pairs[(left + 1) << 32 | right] = self.merge("".join(both)) == both
        return known

    def _last_tokens(self, text: str) -> list[int]:
        """For each prefix of ``text`` (by length) the id of its last token; -1
        where that is a character which is no piece (nothing merges with it)."""
        last = [-1] * (len(text) + 1)
        known, ask = self._pairs.get, self.compatible
        for end, (token, size) in self._auto.iter(text):
            end += 1
            if last[end] < 0:
                before = last[end - size]
                fits = known((before + 1) << 32 | token)
                if fits or fits is None and ask(before, token):
                    last[end] = token
        return last

    def _part_ids(self, part: str) -> tuple[int, ...]:
        last = self._last_tokens(part)
        ids: list[int] = []
        end = len(part)
        while end:
            token = last[end]
            if token < 0:
                ids += [self.byte_ids[b] for b in reversed(part[end - 1].encode())]
                end -= 1
            else:
                ids.append(token)
                end -= len(self.texts[token])
        return tuple(reversed(ids))

    def encode(self, text: str | None) -> list[int]:
        """Ids of ``text`` without begin or end ids; none for null or empty."""
        if not text:
            return []
        marked = (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)
        if not self.by_part:
            return list(self._part_ids(marked))
        parts = (self._parts if self._odd.search(marked) else self._plain_parts).findall(marked)
        return list(chain.from_iterable(map(self._memo.__getitem__, parts)))

    # -- decoding --------------------------------------------------------

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ``ids``: runs of byte ids are read as UTF-8 (a byte that is
        none becomes U+FFFD), the mark of the dummy prefix goes."""
        ids = list(ids)
        if self._high.isdisjoint(ids):
            out = "".join(map(self._shown.__getitem__, ids))
        else:
            parts, run = [], bytearray()
            for i in ids:
                b = self.byte_of.get(i)
                if b is not None:
                    run.append(b)
                    continue
                if run:
                    parts.append(_utf8(bytes(run)))
                    run.clear()
                parts.append(self._shown[i])
            parts.append(_utf8(bytes(run)))
            out = "".join(parts)
        first = next((i for i in ids if self.kinds[i] != CONTROL), None)
        if self.dummy_prefix and first is not None and self.texts[first].startswith(MARK):
            out = out[1:]
        return out

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, sha256 of the comma-joined ids, sha256 of the decoded text."""
        ids = self.encode(text)
        joined = ",".join(map(self._id_text.__getitem__, ids))
        return len(ids), sha256(joined.encode()).hexdigest(), sha256(self.decode(ids).encode()).hexdigest()


def _utf8(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for size in (1, 2, 3, 4):
                try:
                    out.append(raw[at:at + size].decode())
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int), one row per input row; null and empty texts
    have no ids; repeated rows each give a row."""
    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")),
                    lambda c: {"doc_id": c["doc_id"], "ids": [load(model_path).encode(t) for t in c["text"]]},
                    "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text from doc_id, ids; null ids give an empty text."""
    return map_rows(encoded.select("doc_id", "ids"),
                    lambda c: {"doc_id": c["doc_id"], "text": [load(model_path).decode(i or []) for i in c["ids"]]},
                    "doc_id long, text string")


def digest_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: both directions in one
    pass, so that the ids of a corpus need not be stored to be checked."""
    def batch(cols: dict) -> dict:
        found = [load(model_path).digests(t) for t in cols["text"]]
        return {"doc_id": cols["doc_id"], "n_tokens": [f[0] for f in found],
                "ids_sha256": [f[1] for f in found], "decoded_sha256": [f[2] for f in found]}

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")),
                    batch, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
