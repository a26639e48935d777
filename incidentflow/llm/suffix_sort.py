"""Suffix order by two-stage sorting, and adjacent common prefixes, to a bounded depth.

Suffixes smaller than their successors are sorted directly (by 8 bytes at a time, only what is
still tied); the others are induced from them by one scan over the 256 buckets: the predecessor
of each suffix in order, if it is of the other type, is the next of its own bucket.
"""

from __future__ import annotations

import numpy as np


class Suffixes:
    """The suffixes of ``t`` in the order of their first ``depth`` bytes."""

    def __init__(self, t: np.ndarray, depth: int):
        n = len(t)
        self.t, self.n, self.depth = t, n, depth
        pad = np.concatenate([t, np.zeros(depth + 8, np.uint8)])
        key = np.zeros(n + depth, np.uint64)                     # 8 bytes, big-endian, from each place on
        for i in range(8):
            key |= pad[i:i + n + depth].astype(np.uint64) << np.uint64(56 - 8 * i)
        self.key = key
        end = np.append(np.flatnonzero(t[1:] != t[:-1]), n - 1)  # last place of each run of one byte
        up = np.append(t[end[:-1] + 1] > t[end[:-1]], False)
        self.small = np.repeat(up, np.diff(end, prepend=-1))     # smaller than its successor
        self.order = self._induce(self._direct())

    def _tail(self, places: np.ndarray, r: int) -> np.ndarray:
        """The r-th 8 bytes, no further than the depth."""
        k = self.key[places + 8 * r]
        over = 8 * (r + 1) - self.depth
        return k >> np.uint64(8 * over) if over > 0 else k

    def _direct(self) -> np.ndarray:
        s = np.flatnonzero(self.small)
        s = s[np.argsort(self.key[s], kind="stable")]
        if len(s) < 2:
            return s
        new = np.append(True, self.key[s[1:]] != self.key[s[:-1]])
        group = np.cumsum(new)
        at = np.arange(len(s))
        for r in range(1, -(-self.depth // 8)):
            g = group[at]
            tied = np.zeros(len(at), bool)
            same = g[1:] == g[:-1]
            tied[1:] |= same
            tied[:-1] |= same
            at, g = at[tied], g[tied]
            if not len(at):
                break
            if r in (2, 6):                                      # groups equal to the full depth are done
                keep = self._unequal(s[at], g)
                at, g = at[keep], g[keep]
                if not len(at):
                    break
            k = self._tail(s[at], r)
            o = np.lexsort((k, g))
            s[at] = s[at][o]
            k, g = k[o], g[o]
            differ = (k[1:] != k[:-1]) | (g[1:] != g[:-1])
            # new groups need only be distinct among the places still looked at
            group[at] = np.cumsum(np.append(True, differ))
        return s

    def _unequal(self, s: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Members of groups that are not all equal to the full depth."""
        pair = np.flatnonzero(g[1:] == g[:-1])
        bad = np.ones(len(pair), bool)
        left = np.arange(len(pair))
        for r in range(-(-self.depth // 8)):
            left = left[self._tail(s[pair[left]], r) == self._tail(s[pair[left] + 1], r)]
        bad[left] = False
        wrong = np.unique(g[pair[bad]])
        return np.isin(g, wrong)

    def _induce(self, direct: np.ndarray) -> np.ndarray:
        t, small, out = self.t, self.small, []
        waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
        first = np.searchsorted(t[direct], np.arange(257)) if len(direct) else np.zeros(257, np.int64)

        def pass_on(places, c):
            """Predecessors of the other type go to their buckets; those of bucket c come back."""
            p = places[places > 0] - 1
            p = p[~small[p]]
            ch = t[p]
            own = p[ch == c]
            p, ch = p[ch != c], ch[ch != c]
            if len(p):
                p = p[np.argsort(ch, kind="stable")]
                many = np.bincount(ch, minlength=256)
                stop = np.cumsum(many)
                for b in np.flatnonzero(many):
                    waiting[b].append(p[stop[b] - many[b]:stop[b]])
            return own

        if self.n:
            waiting[t[-1]].append(np.array([self.n - 1]))        # before the empty suffix, the smallest
        for c in range(256):
            wave = np.concatenate(waiting[c]) if waiting[c] else np.empty(0, np.int64)
            while len(wave):
                out.append(wave)
                wave = pass_on(wave, c)
            mine = direct[first[c]:first[c + 1]]
            if len(mine):
                out.append(mine)
                pass_on(mine, c)
        return np.concatenate(out) if out else np.empty(0, np.int64)

    def equal_runs(self, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, class): the valid places in order; neighbours with a common prefix of the whole
        depth have one class number."""
        s = self.order[valid[self.order]]
        if not len(s):
            return s, s
        left = np.arange(len(s) - 1)
        for r in range(-(-self.depth // 8)):                     # adjacent common prefixes
            left = left[self._tail(s[left], r) == self._tail(s[left + 1], r)]
        new = np.ones(len(s), np.int64)
        new[left + 1] = 0
        return s, np.cumsum(new) - 1
