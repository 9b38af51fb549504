"""Two-stage suffix sorting of a bounded byte string.

Only suffixes smaller than their successor (type B) are sorted directly, on
their first ``depth`` bytes. All other suffixes (type A) are induced: when the
buckets (suffixes of equal first byte) are scanned in order, each suffix met
puts the suffix before it, if of type A, at the next free place of its bucket.
Adjacent common prefixes then tell which suffixes share their first ``depth``
bytes with a neighbour.
"""

from __future__ import annotations

import numpy as np

#: Symbol that ends each piece; smaller than any byte (bytes are moved up by 1).
END = 0


def symbols(pieces: list[bytes]) -> np.ndarray:
    """The pieces as one array of symbols 1..256, each ended by ``END``."""
    out = np.zeros(sum(map(len, pieces)) + len(pieces), np.uint16)
    at = 0
    for p in pieces:
        out[at:at + len(p)] = np.frombuffer(p, np.uint8).astype(np.uint16) + 1
        at += len(p) + 1
    return out


def smaller_than_next(s: np.ndarray) -> np.ndarray:
    """Type B: suffix i < suffix i + 1. The end symbol counts as type B; in a
    run of equal symbols the type is that of the run's last place."""
    n = len(s)
    less = np.empty(n, bool)
    differs = np.empty(n, bool)
    less[:-1], differs[:-1] = s[:-1] < s[1:], s[:-1] != s[1:]
    less[-1], differs[-1] = True, True
    differs |= s == END
    less |= s == END
    places = np.where(differs, np.arange(n), n)
    nearest = np.minimum.accumulate(places[::-1])[::-1]
    return less[nearest]


def windows(s: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """The first ``depth`` symbols of each suffix as rows, ends padded."""
    padded = np.concatenate([s, np.zeros(depth, np.uint16)])
    return np.lib.stride_tricks.sliding_window_view(padded, depth)[starts]


def _direct_order(s: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` ordered by their first ``depth`` symbols: eight at a time,
    sorting on only among those that are still equal and within their piece."""
    order = np.asarray(starts)
    group = np.zeros(len(order), np.int64)
    padded = np.concatenate([s, np.zeros(depth + 8, np.uint16)]).astype(np.uint64)
    active = np.arange(len(order))
    for at in range(0, depth, 7):
        if not len(active):
            break
        rows = order[active]
        # seven symbols of nine bits in one key; symbols after an end count as ends
        key = np.zeros(len(rows), np.uint64)
        ended = np.zeros(len(rows), bool)
        for k in range(7):
            sym = np.where(ended, np.uint64(0), padded[np.minimum(rows + at + k, len(padded) - 1)])
            if at + k >= depth:
                sym = np.zeros_like(sym)
            ended |= sym == 0
            key = key << np.uint64(9) | sym
        by = np.lexsort((key, group[active]))
        order[active] = rows[by]
        key, own = key[by], group[active]
        new = np.ones(len(active), bool)
        new[1:] = (own[1:] != own[:-1]) | (key[1:] != key[:-1])
        # a new group is named by its first place
        first = np.maximum.accumulate(np.where(new, np.arange(len(active)), 0))
        group[active] = active[first]
        size = np.diff(np.append(np.flatnonzero(new), len(active)))
        alive = np.repeat(size > 1, size) & ~ended[by]
        active = active[alive]
    return order


def suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes, ordered by at least their first ``depth``
    symbols (those equal so far stand together, in any order)."""
    n = len(s)
    if not n:
        return np.empty(0, np.int64)
    small = smaller_than_next(s)
    direct = _direct_order(s, np.flatnonzero(small), depth)
    first = s[direct]
    induced: dict[int, list[np.ndarray]] = {}

    def induce(sorted_places: np.ndarray) -> None:
        before = sorted_places[sorted_places > 0] - 1
        before = before[~small[before]]
        if not len(before):
            return
        head = s[before]
        by = np.argsort(head, kind="stable")
        before, head = before[by], head[by]
        cut = np.flatnonzero(np.append(True, head[1:] != head[:-1]))
        for symbol, part in zip(head[cut].tolist(), np.split(before, cut[1:]), strict=True):
            induced.setdefault(symbol, []).append(part)

    out = []
    for symbol in np.unique(s).tolist():
        # type A first: those found so far, and those that they induce here
        done = 0
        parts = induced.setdefault(symbol, [])
        while done < len(parts):
            part = parts[done]
            done += 1
            out.append(part)
            induce(part)
        lo, hi = np.searchsorted(first, symbol), np.searchsorted(first, symbol, "right")
        out.append(direct[lo:hi])
        induce(direct[lo:hi])
    return np.concatenate(out)


def repeated_starts(pieces: list[bytes], depth: int) -> list[np.ndarray]:
    """For each piece, the starts whose ``depth`` bytes also start at another
    place of the pieces (the common prefix with a neighbour in suffix order is
    at least ``depth``)."""
    s = symbols(pieces)
    edge = np.cumsum([0] + [len(p) + 1 for p in pieces])
    order = suffix_array(s, depth)
    piece = np.searchsorted(edge, order, "right") - 1
    whole = edge[piece + 1] - 1 - order >= depth
    order = order[whole]
    same = np.zeros(len(order) + 1, bool)
    for at in range(0, max(0, len(order) - 1), 4096):
        rows = windows(s, order[at:at + 4097], depth)
        same[at + 1:at + len(rows)] = (rows[1:] == rows[:-1]).all(axis=1)
    hits = np.sort(order[same[:-1] | same[1:]])
    owner = np.searchsorted(edge, hits, "right") - 1
    return [hits[np.searchsorted(owner, i):np.searchsorted(owner, i, "right")] - edge[i] for i in range(len(pieces))]
