"""Licence scan (operator 8): Aho-Corasick over notice phrases and identifier
tags, shunting-yard evaluation of licence expressions. One pass over the text
where it is read; no shuffle."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodline.llm.common import map_rows

#: Phrase words -> label. The first three are the base phrases.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
MORE_PHRASES = {
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2": "mpl-2",
    "mozilla public license 2 0": "mpl-2",
    "eclipse public license": "epl",
    "boost software license": "bsl-1",
    "isc license": "isc",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "released into the public domain": "public-domain",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0 1 0": "cc0",
    "all rights reserved": "all-rights-reserved",
}
#: Identifier of a tag (lower case) -> label.
IDENTIFIERS = {
    "mit": "mit", "apache-2.0": "apache-2", "cc-by-nc-4.0": "cc-by-nc", "cc-by-4.0": "cc-by",
    "cc-by-sa-4.0": "cc-by-sa", "cc0-1.0": "cc0", "gpl-2.0-only": "gpl-2", "gpl-2.0-or-later": "gpl-2",
    "gpl-2.0": "gpl-2", "gpl-3.0-only": "gpl-3", "gpl-3.0-or-later": "gpl-3", "gpl-3.0": "gpl-3",
    "lgpl-2.1-only": "lgpl", "lgpl-3.0-only": "lgpl", "agpl-3.0-only": "agpl", "mpl-2.0": "mpl-2",
    "bsd-2-clause": "bsd-2-clause", "bsd-3-clause": "bsd-3-clause", "isc": "isc", "epl-2.0": "epl",
    "bsl-1.0": "bsl-1", "unlicense": "public-domain",
}
PERMISSIVE = {"mit", "apache-2", "bsd", "bsd-2-clause", "bsd-3-clause", "isc", "bsl-1", "cc0", "cc-by",
              "public-domain"}
TAGS = ("spdx-license-identifier:", "license-expression:")
#: How sure a finding is.
SCORE_TAG, SCORE_PHRASE, SCORE_RESERVED, SCORE_BROKEN_TAG = 1.0, 0.8, 0.5, 0.3

_TO_SPACE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                  for b in range(256))
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_RANK = {"or": 1, "and": 2, "with": 3}


@lru_cache(maxsize=1)
def _phrases() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for phrase, label in {**MORE_PHRASES, **BASE_PHRASES}.items():
        auto.add_word(f" {phrase} ", (len(phrase) + 2, label, phrase in BASE_PHRASES))
    auto.make_automaton()
    return auto


@lru_cache(maxsize=1)
def _tags() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for tag in TAGS:
        auto.add_word(tag, tag)
    auto.make_automaton()
    return auto


@dataclass(frozen=True)
class Verdict:
    labels: frozenset
    permissive: bool


def evaluate_expression(line: str) -> Verdict | None:
    """Value of the licence expression at the start of ``line``; None if there
    is no complete one. ``with`` binds tightest, then ``and``, then ``or``; of
    equal operators the left one goes first. An unknown identifier has no label
    and is not permissive. Permissive: all parts of ``and``,
    some part of ``or``; an exception (``with``) leaves its licence as it is."""
    out: list[Verdict] = []
    ops: list[str] = []
    depth = 0  # open brackets
    operand_next = True

    def reduce_top() -> bool:
        op = ops.pop()
        if len(out) < 2:
            return False
        b, a = out.pop(), out.pop()
        if op == "with":
            out.append(a)
        else:
            both = (a.permissive, b.permissive)
            out.append(Verdict(a.labels | b.labels, all(both) if op == "and" else any(both)))
        return True

    for token in _TOKEN.finditer(line):
        word = token[0].lower()
        if word == "(":
            if not operand_next:
                break
            ops.append(word)
            depth += 1
        elif word == ")":
            if operand_next or not depth:
                break
            while ops[-1] != "(":
                if not reduce_top():
                    return None
            ops.pop()
            depth -= 1
        elif word in _RANK:
            if operand_next:
                return None
            while ops and ops[-1] != "(" and _RANK[ops[-1]] >= _RANK[word]:
                if not reduce_top():
                    return None
            ops.append(word)
            operand_next = True
        else:
            if not operand_next:
                break  # the expression has ended; prose follows
            label = IDENTIFIERS.get(word.rstrip("."))
            out.append(Verdict(frozenset([label] if label else []), label in PERMISSIVE))
            operand_next = False
    if operand_next or depth:
        return None
    while ops:
        if not reduce_top():
            return None
    return out[0] if len(out) == 1 else None


def scan_text(text: str | None) -> dict:
    """All findings of one text; a null text counts as empty. Time and memory
    grow in proportion to the text. Where several findings start or end at one
    place, each counts, but one that lies inside another only as a base phrase."""
    raw = (text or "").encode()
    words = raw.translate(_TO_SPACE).split()
    flat = " " + b" ".join(words).decode("latin-1") + " "
    # by start, the longest first: what ends before an earlier one lies inside it
    found = sorted((end - size + 1, -end, label, base) for end, (size, label, base) in _phrases().iter(flat))
    places, base_labels, labels, score = [], set(), set(), 0.0
    word, counted, reach = 0, 0, -1
    for start, minus_end, label, base in found:
        if base:
            word, counted = word + flat.count(" ", counted, start), start
            places.append(word)
            base_labels.add(label)
        # a phrase inside a longer one only names the longer one
        if base or -minus_end > reach:
            labels.add(label)
            score = max(score, SCORE_RESERVED if label == "all-rights-reserved" else SCORE_PHRASE)
        reach = max(reach, -minus_end)
    verdicts = []
    n_tags = 0
    if b"-license-" in raw.lower() or b"license-expression" in raw.lower():
        low = raw.decode().translate({i: i + 32 for i in range(65, 91)})
        tags = [(end - len(tag) + 1, end + 1) for end, tag in _tags().iter(low)]
        n_tags = len(tags)
        # an expression ends with its line, or where the next tag starts
        for i, (_, at) in enumerate(tags):
            following = tags[i + 1][0] if i + 1 < n_tags else len(low)
            stop = low.find("\n", at, following)
            v = evaluate_expression(low[at:stop if stop >= 0 else following])
            if v is None:
                score = max(score, SCORE_BROKEN_TAG)
            else:
                verdicts.append(v)
                labels |= v.labels
                score = SCORE_TAG
    return {"n_words": len(words), "n_base": len(places),
            "first_word": min(places, default=None), "last_word": max(places, default=None),
            "base_labels": sorted(base_labels), "labels": sorted(labels), "score": score, "n_tags": n_tags,
            "permissive": all(v.permissive for v in verdicts) if verdicts else None}


SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
          "labels array<string>, score double, n_tags long, permissive boolean")


def _batch(cols: dict) -> dict:
    found = [scan_text(t) for t in cols["text"]]
    out = {k: [f[k] for f in found] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels",
                                              "labels", "score", "n_tags", "permissive")}
    return out | {"doc_id": cols["doc_id"]}


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: word count, base phrase places, labels (arrays),
    score, identifier tags and whether all tag expressions are permissive (null
    without a valid one). Null and empty texts have no words and score 0;
    repeated rows each give a row; an empty table gives none. Labels that tie
    in score all stay, sorted. Whole texts are scanned, in time proportional to
    their length. Other columns are not read, whatever their names."""
    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")),
                    _batch, SCHEMA)
