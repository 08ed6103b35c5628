"""Suffix arrays by two-stage sorting, over many short strings at once.

A suffix is of the first kind if it is smaller than its successor. Only these are sorted directly; all others follow from
one scan over the buckets of first bytes, in which each suffix hands its predecessor, if that is of the second kind, the
next place in the bucket of its first byte. A string's end counts as smaller than any byte. Suffixes are ordered by their
first `depth` bytes at least, which is what common prefixes up to that length need.
"""

from __future__ import annotations

import numpy as np


def suffix_order(raw: bytes, begin: np.ndarray, end: np.ndarray, last: np.ndarray, depth: int) -> np.ndarray:
    """The places in raw of suffixes, sorted: of each string raw[begin:end] those that start up to and including `last`
    (strings with last < begin have none). Strings follow each other with one byte of any value between them."""
    b = np.frombuffer(raw, np.uint8)
    sym = b.astype(np.int16) + 1
    sym[end] = 0  # the byte between
    n = len(sym)
    step = np.zeros(n, np.int16)
    step[:-1] = sym[1:] - sym[:-1]
    step[-1] = -1
    where = np.where(step != 0, np.arange(n), n - 1)
    where = np.minimum.accumulate(where[::-1])[::-1]
    small = step[where] > 0  # smaller than its successor; runs of one byte follow their end
    small[end] = True  # strings' ends start the scan
    nxt = np.where(small, np.arange(n), n - 1)
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]
    # the suffixes that are asked for, and those that hand the last of them their places
    some = last >= begin
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, begin[some], 1)
    np.add.at(mark, nxt[last[some]] + 1, -1)
    need = np.cumsum(mark[:-1]) > 0
    asked = np.zeros(n + 1, np.int32)
    np.add.at(asked, begin[some], 1)
    np.add.at(asked, last[some] + 1, -1)
    asked = np.cumsum(asked[:-1]) > 0
    direct = np.flatnonzero(need & small & (sym > 0))
    stop = end[np.searchsorted(end, direct)]
    stop = np.minimum(direct + depth, stop)
    keys = [raw[i:j] for i, j in zip(direct.tolist(), stop.tolist(), strict=True)]
    direct = direct[np.array(sorted(range(len(keys)), key=keys.__getitem__), dtype=np.int64)]
    first = sym[direct]
    cuts = np.searchsorted(first, np.arange(258))
    handed: list[list[np.ndarray]] = [[] for _ in range(257)]
    out: list[np.ndarray] = []
    gets = need & ~small

    def hand(places: np.ndarray, c: int) -> np.ndarray:
        """Hands the predecessors of these suffixes their places; returns those of the bucket that is being scanned."""
        p = places[places > 0] - 1
        p = p[gets[p]]
        s = sym[p]
        own = p[s == c]
        p, s = p[s != c], s[s != c]
        if len(p):
            order = np.argsort(s, kind="stable")
            p, s = p[order], s[order]
            at = np.flatnonzero(np.diff(s)) + 1
            for d, part in zip(s[np.append(0, at)].tolist(), np.split(p, at), strict=True):
                handed[d].append(part)
        return own

    hand(np.flatnonzero(need & (sym == 0)), 0)
    for c in range(1, 257):
        wave = np.concatenate(handed[c]) if handed[c] else np.zeros(0, np.int64)
        while len(wave):
            out.append(wave)
            wave = hand(wave, c)
        if cuts[c + 1] > cuts[c]:
            part = direct[cuts[c] : cuts[c + 1]]
            out.append(part)
            hand(part, c)
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    return order[asked[order]]


def words_at(b: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on as one number; bytes beyond the end are 0."""
    x = np.zeros(len(b) + 8, np.uint64)
    x[: len(b)] = b
    out = np.zeros(len(b), np.uint64)
    for k in range(8):
        out |= x[k : k + len(b)] << np.uint64(8 * k)
    return out


def common(raw: bytes, order: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix but the first whether it shares its first `depth` bytes (a multiple of 8) with the one before.

    The last bytes are compared first, as sorted neighbours mostly differ there. Of pairs whose places follow each other by
    one byte, both of them, all agree if the first does: the next adds one byte only, among those last bytes.
    """
    w = words_at(np.frombuffer(raw, np.uint8))

    def agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, left = np.zeros(len(a), bool), np.arange(len(a))
        for k in range(depth - 16, -8, -8):
            ok = w[a + k] == w[b + k]
            if not ok.all():
                left, a, b = left[ok], a[ok], b[ok]
        out[left] = True
        return out

    same = np.zeros(max(len(order) - 1, 0), bool)
    at = np.flatnonzero(w[order[:-1] + (depth - 8)] == w[order[1:] + (depth - 8)])
    at = at[np.argsort(order[at])]
    a, b = order[at], order[at + 1]
    head = np.ones(len(at), bool)
    head[1:] = (np.diff(a) != 1) | (np.diff(b) != 1)
    good = agree(a[head], b[head])[np.cumsum(head) - 1]
    rest = np.flatnonzero(~good & ~head)
    good[rest] = agree(a[rest], b[rest])
    same[at[good]] = True
    return same
