"""Simple-8b: word-aligned coding of unsigned integers, vectorised over blocks of values.

A 64-bit word has a 4-bit selector (which of the layouts below) and 60 bits of payload. Blocks of
``block`` values are coded independently, so their word offsets allow decoding any of them
alone; all blocks of a call advance together, one word each step. A value of more than 60
bits is an escape: selector 0 with the value's place in a list of raw 64-bit values.
"""

from __future__ import annotations

import numpy as np

# --- fixed values: values per word and bits per value of selectors 1, 2, 3, ... ---
LAYOUTS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12),
           (4, 15), (3, 20), (2, 30), (1, 60))
BLOCK = 128                    # short blocks: more of them advance together


def _bits(v: np.ndarray) -> np.ndarray:
    """Bit length of each value, at least 1."""
    out = np.ones(len(v), np.uint8)
    for k in range(1, 64):
        more = v >= np.uint64(1 << k)
        if not more.any():
            break
        out += more
    return out


def encode(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each block, escapes)."""
    v = np.asarray(values, np.uint64)
    n, lanes = len(v), -(-len(v) // block)
    if n == 0:
        z = np.empty(0, np.uint64)
        return z, np.empty(0, np.int32), z
    size = np.full(lanes, block)
    size[-1] = n - block * (lanes - 1)
    wide = block + 60
    pad = np.zeros((lanes, wide), np.uint64)
    whole = np.zeros(lanes * block, np.uint64)
    whole[:n] = v
    pad[:, :block] = whole.reshape(lanes, block)
    bits = _bits(pad.ravel())
    escapes = pad.ravel()[bits > 60]
    order = np.cumsum(bits > 60) - 1
    peak, span, now = {}, 1, bits          # peak[c][i]: widest of the c values from i on
    maxima = {1: bits}
    while span < 32:
        nxt = now.copy()
        np.maximum(nxt[:-span], now[span:], out=nxt[:-span])
        span, now = span * 2, nxt
        maxima[span] = now
    for c, w in LAYOUTS:
        half = 1 << (c.bit_length() - 1)
        m = maxima[half]
        top = m.copy()
        if c > half:
            np.maximum(top[:-(c - half)], m[c - half:], out=top[:-(c - half)])
        peak[c] = top <= w
    flat, at = pad.ravel(), np.zeros(lanes, np.int64)
    rows, made, lane_of, live = np.arange(lanes) * wide, [], [], np.arange(lanes)
    while len(live):
        pos = rows[live] + at[live]
        word, took = np.zeros(len(live), np.uint64), np.ones(len(live), np.int64)
        todo = np.ones(len(live), bool)
        for s, (c, w) in enumerate(LAYOUTS, 1):
            fit = np.flatnonzero(todo & peak[c][pos])
            if len(fit):
                todo[fit] = False
                take = flat[pos[fit][:, None] + np.arange(c)]
                shift = (np.arange(c, dtype=np.uint64) * np.uint64(w))
                word[fit] = np.bitwise_or.reduce(take << shift, axis=1) | np.uint64(s << 60)
                took[fit] = c
        if todo.any():
            word[todo] = order[pos[todo]].astype(np.uint64)
        made.append(word)
        lane_of.append(live)
        at[live] += took
        live = live[at[live] < size[live]]
    lane = np.concatenate(lane_of)
    words = np.concatenate(made)[np.argsort(lane, kind="stable")]
    per = np.bincount(lane, minlength=lanes)
    return words, (np.cumsum(per) - per).astype(np.int32), escapes


def decode(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The n values; ``offsets`` are the first words of the blocks."""
    out = np.zeros(n + 60, np.uint64)
    if n == 0:
        return out[:0]
    holds = np.array([1, *(c for c, _ in LAYOUTS), 0])
    sel = (words >> np.uint64(60)).astype(np.int64)
    count = holds[sel]
    run = np.cumsum(count) - count
    lane = np.searchsorted(offsets, np.arange(len(words)), side="right") - 1
    start = run - run[offsets][lane] + lane * block
    end = np.minimum((lane + 1) * block, n)
    body = words & np.uint64((1 << 60) - 1)
    for s in np.unique(sel):
        at = np.flatnonzero(sel == s)
        if s == 0:
            out[start[at]] = escapes[body[at].astype(np.int64)]
            continue
        c, w = LAYOUTS[s - 1]
        got = (body[at][:, None] >> (np.arange(c, dtype=np.uint64) * np.uint64(w))) & np.uint64((1 << w) - 1)
        place = start[at][:, None] + np.arange(c)
        keep = place < end[at][:, None]
        out[place[keep]] = got[keep]
    return out[:n]
