"""A packed R-tree over count vectors, for candidates of a Jaccard threshold.

Tokens of a set are hashed into groups; the group counts are a point. The overlap of two sets is
at most the sum of the coordinate minima of their points, and with the upper corner of a node's box at
most that of any point below it, so whole nodes are passed over.
"""

from __future__ import annotations

import numpy as np

GROUPS = 16
FINE = 1024                    # groups of which only the parity of the count is kept
FANOUT = 16


def unlike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fine groups whose counts differ in parity: at least so many tokens are in one set only, so the summed
    minima over the fine groups are at most half of both sizes less this."""
    return np.bitwise_count(a ^ b).sum(axis=-1).astype(np.int64)


def enough(bound: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """True where an overlap of ``bound`` would reach the threshold: 100 o >= percent (a + b - o)."""
    return (100 + percent) * bound >= percent * (a + b)


class CountTree:
    """Points sorted by set size, packed into boxes level by level."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, percent: int):
        self.order = np.lexsort((points[:, 0], sizes))
        self.points, self.sizes, self.percent = points[self.order], sizes[self.order].astype(np.int64), percent
        self.levels = []                              # from the leaves up: (upper corner, least size, largest size)
        top, lo, hi = self.points, self.sizes, self.sizes
        while len(top) > FANOUT:
            at = np.arange(0, len(top), FANOUT)
            top, lo, hi = (np.maximum.reduceat(top, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at))
            self.levels.append((top, lo, hi))

    def near(self, point: np.ndarray, size: int) -> np.ndarray:
        """Indexes of the points that may reach the threshold with this one."""
        p, n = self.percent, len(self.points)
        at = np.arange(len(self.levels[-1][0]) if self.levels else n)
        for k in range(len(self.levels) - 1, -1, -1):
            top, lo, hi = self.levels[k]
            least = np.maximum(lo[at], -(-p * size // 100))
            ok = ((100 * hi[at] >= p * size) & (p * lo[at] <= 100 * size)
                  & enough(np.minimum(top[at], point).sum(axis=1), size, least, p))
            below = len(self.levels[k - 1][0]) if k else n
            at = (at[ok][:, None] * FANOUT + np.arange(FANOUT)).ravel()
            at = at[at < below]
        ok = enough(np.minimum(self.points[at], point).sum(axis=1), size, self.sizes[at], p)
        return self.order[at[ok]]
