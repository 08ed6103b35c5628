"""Words, hashes and shingles of whole Arrow batches of texts, by NumPy over their UTF-8 bytes.

Bytes beyond ASCII are word bytes, as code points beyond ASCII are, so that no decoding is needed. A text is worked on as
a whole, in chunks of whole texts; memory is bounded by the longest text or CHUNK bytes, times about forty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 21
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)

_low = np.arange(256, dtype=np.uint8)
_low[65:91] += 32
LOWERED = _low
WORD_BYTE = np.zeros(256, bool)  # after lowering
WORD_BYTE[48:58] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True
RUN_BYTE = np.ones(256, bool)
RUN_BYTE[[32, 9, 10, 11, 12, 13]] = False

_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        for k, b in ((0, _BASE), (1, _INV)):
            p = np.full(n, b, U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def prefix_hash(b: np.ndarray) -> np.ndarray:
    """Running polynomial sums of bytes; differences give the hash of any stretch (see stretch_hash)."""
    pw, _ = powers(len(b) + 1)
    c = np.zeros(len(b) + 1, U)
    np.cumsum((b.astype(U) + U(1)) * pw[: len(b)], out=c[1:])
    return c


def stretch_hash(c: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    _, inv = powers(len(c))
    return mix((c[stop] - c[start]) * inv[start])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of an Arrow column of strings or binaries without nulls."""
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        kind = np.int64
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """first, last, bytes, offsets: stretches of whole texts, of about so many bytes."""
    raw, off = buffers(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def word_stretches(b: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start and stop of each word, and the first word of each text (one more at the end)."""
    w = inside[b]
    edge = np.zeros(len(b) + 1, bool)
    edge[off] = True
    starts = w.copy()
    starts[1:] &= ~w[:-1] | edge[1:-1]
    stops = w
    stops[:-1] &= ~w[1:] | edge[1:-1]
    starts, stops = np.flatnonzero(starts), np.flatnonzero(stops) + 1
    return starts, stops, np.searchsorted(starts, off)


def word_hashes(b: np.ndarray, off: np.ndarray, inside: np.ndarray = WORD_BYTE) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, A-Z in lower case, and the first word of each text."""
    b = LOWERED[b]
    starts, stops, first = word_stretches(b, off, inside)
    return stretch_hash(prefix_hash(b), starts, stops), first


_MULT = mix(np.arange(101, 133, dtype=U)) | U(1)


def shingles(h: np.ndarray, first: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of each text and the first shingle of each; a text with fewer words, but not none,
    has one, of all its words."""
    count = np.diff(first)
    if len(h) < n:
        total = np.zeros(0, U)
    else:
        total = np.zeros(len(h) - n + 1, U)
        for k in range(n):
            total += h[k : len(h) - n + 1 + k] * _MULT[k]
    out_count = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    at = np.concatenate(([0], np.cumsum(out_count)))
    src = np.repeat(first[:-1] - at[:-1], out_count) + np.arange(at[-1])
    out = np.zeros(at[-1], U)
    ok = src < len(total)
    out[ok] = total[src[ok]]
    for i in np.flatnonzero((count > 0) & (count < n)):
        w = h[first[i] : first[i + 1]]
        out[at[i]] = (w * _MULT[: len(w)]).sum(dtype=U) + U(len(w))
    return mix(out), at


def groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """The groups of sorted batches by their first columns; one group is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([np.asarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in range(n_keys)], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for a, z in zip(cuts, cuts[1:], strict=False):
            key = tuple(keys[a].tolist())
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, z - a))
            last = key
    if held:
        yield last, pa.Table.from_batches(held)


def forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes reaches over edges (u, v)."""
    low = np.arange(n)
    while len(u):
        a, b = low[u], low[v]
        go = a != b
        if not go.any():
            break
        u, v, a, b = u[go], v[go], a[go], b[go]
        np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(nxt := low[low], low):
            low = nxt
    return low
