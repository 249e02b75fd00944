"""Vectorised word and shingle hashes over the buffers of an Arrow text column.

Words are runs of bytes outside space and 0x09-0x0D, A-Z lower-cased.  A word's
hash is a polynomial over its bytes modulo 2**64, mixed with its length; no
Python object is made for any word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_TURN = 1 << 16
_B = U(0x9E3779B97F4A7C15 | 1)
with np.errstate(over="ignore"):
    _POW = np.cumprod(np.full(_TURN, _B, dtype=U))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Breaks between runs of letters and digits (bytes beyond ASCII count as letters).
MARKS = np.ones(256, dtype=bool)
MARKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: Bytes of text worked on at once, unless one text is longer.
CHUNK = 1_000_000
#: Bytes of one text beyond which it is read in pieces.
LONG = 1 << 22


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
        return h ^ (h >> U(31))


def runs(column: pa.Array, chunk: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets into them) for runs of rows of about ``chunk`` bytes; nulls are empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    k = 0
    while k < len(column):
        stop = max(k + 1, int(np.searchsorted(at, at[k] + chunk, side="right")) - 1)
        yield k, data[at[k] : at[stop]], at[k : stop + 1] - at[k]
        k = stop


def words(data: np.ndarray, at: np.ndarray, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, offsets of rows into the words); ``breaks``: bytes between words.

    Long texts are read in pieces of about LONG bytes that end at a break.
    """
    if len(data) > LONG:
        cuts = [0]
        while cuts[-1] < len(data):
            end = cuts[-1] + LONG
            while end < len(data) and not breaks[data[end : end + 4096]].any():
                end += 4096
            cuts.append(end + int(breaks[data[end : end + 4096]].argmax()) if end < len(data) else len(data))
        if len(cuts) > 2:
            made = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                own = at[(at >= a) & (at <= b)] - a
                h, starts, ends, _ = words(data[a:b], np.unique(np.concatenate([[0], own, [b - a]])), breaks)
                made.append((h, starts + a, ends + a))
            h, starts, ends = (np.concatenate(x) for x in zip(*made))
            return h, starts, ends, np.searchsorted(starts, at)
    if not len(data):
        z = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=U), z, z, np.zeros(len(at), dtype=np.int64)
    space = breaks[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[at] = True
    inside = ~space
    begins = inside & cut[:-1]
    begins[1:] |= inside[1:] & space[:-1]
    stops = inside & cut[1:]
    stops[:-1] |= inside[:-1] & space[1:]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    rows = np.searchsorted(starts, at)
    if not len(starts):
        return np.zeros(0, dtype=U), starts, ends, rows
    sizes = ends - starts
    kept = _LOWER[data[inside]].astype(U)
    firsts = np.cumsum(sizes) - sizes
    place = np.arange(len(kept), dtype=np.int64) - np.repeat(firsts, sizes)
    with np.errstate(over="ignore"):
        h = np.add.reduceat((kept + U(1)) * _POW[place & (_TURN - 1)], firsts)
        h = mix(h + sizes.astype(U) * U(0xD1B54A32D192ED03))
    return h, starts, ends, rows


def shingles(h: np.ndarray, a: int, b: int, size: int) -> np.ndarray:
    """The sorted distinct hashes of ``size``-word shingles of words a..b; the
    whole sequence as one where there are fewer; none without words."""
    n = b - a
    if n <= 0:
        return h[:0]
    size = min(size, n)
    with np.errstate(over="ignore"):
        out = h[a : b - size + 1] * U(0xA0761D6478BD642F) + U(size)
        for k in range(1, size):
            out = mix(out) + h[a + k : b - size + 1 + k] * U(0xE7037ED1A0B428DB)
    return np.unique(mix(out))
