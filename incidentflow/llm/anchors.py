"""Content-defined anchors: the windows of a text that hold a certain gram as their smallest.

Of the k-byte grams inside a window of ``width`` bytes the one with the smallest hash (the leftmost
of equal ones) is the window's anchor. It depends on the window's bytes alone, so equal windows
have equal anchors at the same place inside them, wherever they stand. Consecutive windows
mostly share an anchor and are kept as one run.
"""

from __future__ import annotations

import numpy as np

from .common import mix

GRAM = 32


def _minimum(key: np.ndarray, w: int) -> np.ndarray:
    """Smallest of every w consecutive entries."""
    span, now = 1, key
    while span * 2 <= w:
        now = np.minimum(now[:-span], now[span:])
        span *= 2
    return now if span == w else np.minimum(now[:len(key) - w + 1], now[w - span:])


def gram_hash(data: np.ndarray, k: int = GRAM) -> np.ndarray:
    """Hash of every k-byte gram (k a power of two)."""
    h, span = mix(data.astype(np.uint64) + np.uint64(1)), 1
    m = np.uint64(0x9E3779B97F4A7C15)
    while span < k:
        h = h[:-span] * m + h[span:]
        m, span = m * m, span * 2
    return mix(h)


def runs(data: np.ndarray, off: np.ndarray, width: int, k: int = GRAM):
    """(row, first window, windows, anchor's hash) of every run; places are relative to the row."""
    none = np.empty(0, np.int64)
    if len(data) < width:
        return none, none, none, np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = gram_hash(data, k)
    key = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    at = (_minimum(key, width - k + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)   # one for each window
    size = np.diff(off)
    row = np.flatnonzero(size >= width)
    if not len(row):
        return none, none, none, np.empty(0, np.uint64)
    new = np.zeros(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    new[off[row]] = True
    valid = np.zeros(len(at) + 1, np.int64)
    np.add.at(valid, off[row], 1)
    np.add.at(valid, off[row] + size[row] - width + 1, -1)
    ok = np.cumsum(valid[:-1]) > 0
    start = np.flatnonzero(new & ok)
    own = np.searchsorted(off, start, side="right") - 1
    last = off[own] + size[own] - width + 1                    # end of the row's windows
    n = np.minimum(np.append(start[1:], len(at)), last) - start
    return own, start - off[own], n, h[at[start]]
