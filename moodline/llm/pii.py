"""Personal data with offset-preserving deobfuscation (operator 10).

The plain detectors run on the text itself. A chain of transducers then
rewrites disguises (look-alike characters, invisible characters, spelled
digits, "at"/"dot") into a normalised copy that keeps, for each character, the
source range it came from. The same detectors run on the copy and their spans
are mapped back. Only texts that hold a disguise are rewritten. One pass where
the text is read; no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodline.llm.common import map_rows

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The lookbehind and the bound of 12 keep the scan linear on long digit runs;
# neither changes which matches survive their checks.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){11,}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


@dataclass(frozen=True)
class Span:
    start: int
    kind: str
    end: int

    def key(self) -> tuple:
        return self.start, KINDS.index(self.kind), self.end

    def __str__(self) -> str:
        return f"{self.kind}:{self.start}:{self.end}"


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches of the e-mail pattern, found from each @ outwards: the local
    part is the whole run before it, which is where a leftmost match starts."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(done, at + 1))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v)
    return total % 10 == 0


def _part_ok(part: str) -> bool:
    p = part.lstrip("0")
    return len(p) < 4 and int(p or 0) <= 255


def detect(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its check."""
    out = [Span(s, "email", e) for s, e in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(map(_part_ok, m[0].split("."))):
            out.append(Span(m.start(), "ip", m.end()))
    for m in _CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(Span(m.start(), "card", m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(Span(m.start(), "phone", m.end()))
    return sorted(out, key=Span.key)


# -- transducers ------------------------------------------------------------

#: Characters that look like an ASCII one. Full-width forms
#: follow a rule (their code point less 0xFEE0).
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "ο": "o", "α": "a", "ν": "v", "ı": "i",
    "。": ".", "․": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", " ": " ", " ": " ",
} | {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
INVISIBLE = "­​‌‍⁠﻿"
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5",
               "six": "6", "seven": "7", "eight": "8", "nine": "9"}

_GLYPH = re.compile("[" + "".join(map(re.escape, [*LOOK_ALIKES, *INVISIBLE])) + "]")
_BRACKET_AT = re.compile(r"[ \t]{0,3}[\[({<][ \t]{0,3}(?:at|@)[ \t]{0,3}[\])}>][ \t]{0,3}", re.I)
_BRACKET_DOT = re.compile(r"[ \t]{0,3}[\[({<][ \t]{0,3}(?:dot|punkt|\.)[ \t]{0,3}[\])}>][ \t]{0,3}", re.I)
_ANY_BRACKET = re.compile(r"[\[({<][ \t]{0,3}(?:at|@|dot|punkt|\.)[ \t]{0,3}[\])}>]", re.I)
_DOT_WORD = r"[ \t]{1,3}dot[ \t]{1,3}"
_WORD_DOT = re.compile(
    r"(?<![A-Za-z0-9._%+-])(?P<local>[A-Za-z0-9._%+-]{1,64})(?P<at>[ \t]{1,3}at[ \t]{1,3}|@)[A-Za-z0-9-]{1,63}"
    rf"(?:(?:{_DOT_WORD}|\.)(?P<last>[A-Za-z0-9-]{{1,63}})){{1,8}}", re.I)
_AT_HOST = re.compile(r"[A-Za-z0-9._%+-][ \t]{1,3}at[ \t]{1,3}[A-Za-z0-9-]{1,63}\.[A-Za-z0-9-]", re.I)
#: Endings for which "name at host.ending" is an address, and
#: words before "at" with which it is a sentence about a site.
ENDINGS = frozenset("com org net edu gov mil int info biz io co ai app dev me us uk de fr es it nl eu ch at be se no dk "
                    "pl ru jp cn in br au ca nz ie pt fi cz gr tr mx ar za kr".split())
NOT_NAMES = frozenset("a all also am and are available back be book booked bought buy check click date day directly down "
                      "download event find found free here home hosted in is it items join learn left link listed live "
                      "located look looked looking me meet met more new now offline on online only open order out page "
                      "pages place points post posted posts published read register right sale see seen shop shopping sign "
                      "site sold stay still store stuff tickets time today us up visit was we week were work worked working "
                      "year you".split())
#: What a word of a spelled number stands for.
NUMBER_WORDS = DIGIT_WORDS | {"hundred": "00", "thousand": "000"}
_PART = "(?:" + "|".join(NUMBER_WORDS) + "|[0-9]{1,19})"
_GAP = r"[ \t,-]{1,3}"
_SPELLED = re.compile(rf"(?<![A-Za-z0-9])(?:plus[ \t-]{{1,3}}|\+)?{_PART}(?:{_GAP}{_PART}){{2,}}(?![A-Za-z0-9])", re.I)
_SPELLED_PART = re.compile(rf"plus|{_PART}|[ \t,-]+", re.I)
_OCTET = rf"{_PART}(?:[ \t-]{{1,3}}{_PART}){{0,2}}"
_SPELLED_IP = re.compile(rf"(?<![A-Za-z0-9.]){_OCTET}(?:(?:{_DOT_WORD}|\.){_OCTET}){{3}}(?![A-Za-z0-9])", re.I)
_IP_PART = re.compile(rf"dot|{_PART}|[ \t-]+|\.", re.I)
#: Digits that a run of words and digits must have to be rewritten.
MIN_DIGITS = 7


@dataclass
class Aligned:
    """A normalised text; character i comes from source [starts[i], ends[i])."""
    text: str
    starts: list[int]
    ends: list[int]

    @staticmethod
    def of(text: str) -> Aligned:
        return Aligned(text, list(range(len(text))), list(range(1, len(text) + 1)))

    def rewrite(self, pattern: re.Pattern, replace: Callable[[re.Match], list[tuple[int, int, str]]]) -> Aligned:
        """Replace pieces: ``replace`` gives (from, to, new) ranges of this text
        in order; each character of ``new`` covers the whole range's source."""
        text, starts, ends, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            for a, b, new in replace(m):
                text.append(self.text[at:a] + new)
                starts += self.starts[at:a] + [self.starts[a]] * len(new)
                ends += self.ends[at:a] + [self.ends[b - 1]] * len(new)
                at = b
        if not at:
            return self
        return Aligned("".join(text) + self.text[at:], starts + self.starts[at:], ends + self.ends[at:])


def _glyphs(m: re.Match) -> list:
    return [(m.start(), m.end(), LOOK_ALIKES.get(m[0], ""))]


def _word_dots(m: re.Match) -> list:
    """"at" and "dot" as words inside one address-like run. A plain "@" with
    plain dots is left as it is; so is "at" before a host with plain dots if
    the ending is unknown or the word before it is no name."""
    dots = [(m.start() + d.start(), m.start() + d.end(), ".") for d in re.finditer(_DOT_WORD, m[0], re.I)]
    if m["at"] == "@":
        return dots
    if not dots and (m["last"].lower() not in ENDINGS or m["local"].lower() in NOT_NAMES):
        return []
    return [(*m.span("at"), "@"), *dots]


def _spelled(m: re.Match) -> list:
    """Number words become digits, what parts them one space ("plus one" ->
    "+1"); digits stay. Runs without a word, or of few digits, are left."""
    out, digits, words, after = [], 0, 0, ""
    for p in _SPELLED_PART.finditer(m[0]):
        piece, place = p[0].lower(), (m.start() + p.start(), m.start() + p.end())
        if piece == "plus":
            out.append((*place, "+"))
        elif piece in NUMBER_WORDS:
            out.append((*place, NUMBER_WORDS[piece]))
            digits, words = digits + len(NUMBER_WORDS[piece]), words + 1
        elif piece.isdigit():
            digits += len(piece)
        else:
            # nothing after "plus", and "nine hundred" is one number
            hundred = m[0][p.end():p.end() + 8].lower().startswith(("hundred", "thousand"))
            out.append((*place, "" if after == "plus" or hundred else " "))
        after = piece
    return out if words and digits >= MIN_DIGITS else []


def _spelled_ip(m: re.Match) -> list:
    """Four numbers in words or digits, parted by "dot" or a plain dot."""
    if m[0].replace(".", "").isdigit():
        return []
    out = []
    for p in _IP_PART.finditer(m[0]):
        piece, place = p[0].lower(), (m.start() + p.start(), m.start() + p.end())
        new = NUMBER_WORDS.get(piece, "." if piece in ("dot", ".") else piece if piece.isdigit() else "")
        out.append((*place, new))
    return out


def deobfuscate(text: str) -> Aligned | None:
    """The normalised copy of ``text``, or None if it holds no disguise."""
    glyph = not text.isascii() and _GLYPH.search(text)
    low = text.lower()
    spelled = not DIGIT_WORDS.keys().isdisjoint(low.replace("-", " ").replace(",", " ").split())
    at = ("at " in low or "at\t" in low) and _AT_HOST.search(text) is not None
    if not (glyph or spelled or at or " dot " in low or _ANY_BRACKET.search(text)):
        return None
    now = plain = Aligned.of(text)
    if glyph:
        now = now.rewrite(_GLYPH, _glyphs)
    now = now.rewrite(_BRACKET_AT, lambda m: [(m.start(), m.end(), "@")])
    now = now.rewrite(_BRACKET_DOT, lambda m: [(m.start(), m.end(), ".")])
    if spelled or glyph:
        now = now.rewrite(_SPELLED_IP, _spelled_ip)
    now = now.rewrite(_WORD_DOT, _word_dots)
    if spelled or glyph:
        now = now.rewrite(_SPELLED, _spelled)
    return None if now is plain else now


def scan_text(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), offsets in code points, ends exclusive."""
    text = text or ""
    base = detect(text)
    copy = deobfuscate(text)
    if copy is None:
        return base, base
    more = []
    for s in detect(copy.text):
        start, end = copy.starts[s.start], copy.ends[s.end - 1]
        # a base span may be a fragment of it, or be of another kind
        if not any(b.kind == s.kind and b.start <= start and end <= b.end for b in base):
            more.append(Span(start, s.kind, end))
    return base, sorted({*base, *more}, key=Span.key)


def _join(spans: list[Span]) -> str:
    return ",".join(map(str, spans))


def _batch(cols: dict) -> dict:
    found = [scan_text(t) for t in cols["text"]]
    out = {f"n_{k}": [sum(s.kind == k for s in base) for base, _ in found] for k in KINDS}
    return out | {"doc_id": cols["doc_id"], "base_spans": [_join(b) for b, _ in found],
                  "spans": [_join(a) for _, a in found]}


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: counts of the base kinds, base_spans and spans
    ("kind:start:end", comma-joined). Null and empty texts have none. Spans that
    start together are in the order of KINDS, equal ones are given once. Whole
    texts are scanned, in time proportional to their length; repeated rows each
    give a row, an empty table none; other columns are not read."""
    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")),
                    _batch, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
                            "base_spans string, spans string")


def mask_text(text: str | None) -> str | None:
    """``text`` with every span replaced by its kind in brackets; spans that
    overlap are replaced together under the first one's kind."""
    if not text:
        return text
    _, spans = scan_text(text)
    if not spans:
        return text
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out.append(text[at:s.start] + f"[{s.kind.upper()}]")
        at = max(at, s.end)
    return "".join(out) + text[at:]


def mask_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with its texts masked and n_chars (if present) counted anew;
    all other columns as they are, whatever their names."""
    masked = F.pandas_udf(lambda s: s.map(mask_text, na_action="ignore"), "string")
    out = docs.withColumn("text", masked("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out
