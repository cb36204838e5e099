"""Links between fingerprints by a Gray-ordered hierarchical index.

Fingerprints are sorted by Gray rank, so neighbours share most bits. Each node of the hierarchy keeps
the bits that all fingerprints below it share (mask and pattern). A pair of nodes is pruned as a
whole when the shared bits differ in more than ``distance`` places; otherwise its children meet.
"""

from __future__ import annotations

import numpy as np

FANOUT = 8
PAIRS_AT_ONCE = 1 << 18


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Position of a bit pattern in the reflected Gray sequence."""
    v = values.astype(np.uint64, copy=True)
    for shift in (1, 2, 4, 8, 16, 32):
        v ^= v >> np.uint64(shift)
    return v


class GrayIndex:
    """Index of many groups at once: ``values`` sorted by group and Gray rank, ``starts`` of the groups."""

    def __init__(self, values: np.ndarray, starts: np.ndarray):
        self.levels = [(values, np.full(len(values), np.iinfo(np.uint64).max, np.uint64), None)]
        first = np.append(starts, len(values))
        while len(first) - 1 < len(self.levels[-1][0]):
            pattern, mask, _ = self.levels[-1]
            sizes = np.diff(first)
            nodes = -(-sizes // FANOUT)
            group = np.repeat(np.arange(len(sizes)), nodes)
            place = np.arange(nodes.sum()) - np.repeat(np.cumsum(nodes) - nodes, nodes)
            child = first[group] + place * FANOUT
            bounds = np.append(child, len(pattern))
            agree = np.bitwise_and.reduceat(mask, child)
            agree &= ~np.bitwise_or.reduceat(pattern ^ np.repeat(pattern[child], np.diff(bounds)), child)
            self.levels.append((pattern[child], agree, bounds))
            first = np.append(np.cumsum(nodes) - nodes, nodes.sum())

    def links(self, distance: int):
        """Yields arrays (i, j), i < j, of positions in one group that differ in at most ``distance`` bits."""
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top][0]))
        stack = [(top, roots, roots)]
        while stack:
            level, a, b = stack.pop()
            if len(a) > PAIRS_AT_ONCE:
                half = len(a) // 2
                stack += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
                continue
            pattern, mask, bounds = self.levels[level]
            keep = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= distance
            a, b = a[keep], b[keep]
            if level == 0:
                inner = a < b
                if inner.any():
                    yield a[inner], b[inner]
                continue
            wide = (bounds[b + 1] - bounds[b])
            count = (bounds[a + 1] - bounds[a]) * wide
            pair = np.repeat(np.arange(len(a)), count)
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            left, right = bounds[a][pair] + at // wide[pair], bounds[b][pair] + at % wide[pair]
            ordered = left <= right
            stack.append((level - 1, left[ordered], right[ordered]))


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Fold links into component labels (in place; a label is the smallest position)."""
    while True:
        x, y = labels[a], labels[b]
        if (x == y).all():
            return
        low = np.minimum(x, y)
        np.minimum.at(labels, x, low)
        np.minimum.at(labels, y, low)
        while True:
            jumped = labels[labels]
            if (jumped == labels).all():
                break
            labels[:] = jumped
