"""Run-length BWT index of a set of byte strings, in NumPy.

``RunLengthIndex`` keeps the runs of the Burrows-Wheeler transform and, for the first and last
row of every run, the text position (a sampled run end) and the longest common prefix with the
row outside the run. Inside a run nothing needs to be kept: if two neighbouring rows have the
same preceding character, the match of the preceding position is longer by exactly one. So the
matching statistics of all positions stream left to right from the samples.
"""

from __future__ import annotations

import numpy as np

from kinolake.llm.blocks import powers

_BASE = 0x9E6C63D0876A9A47


class RunLengthIndex:
    def __init__(self, texts: list[bytes]):
        lengths = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(lengths)
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.member = np.repeat(np.arange(len(texts)), lengths)
        rows = self._suffix_order()
        n = len(rows)
        # the character before each suffix; a text's first position gets one of its own
        first = np.zeros(n, bool)
        first[(self.ends - lengths)[lengths > 0]] = True
        before = np.where(first[rows], 256 + self.member[rows], self.data[rows - 1].astype(np.int64))
        head = np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1])))
        self.run_chars = before[head]
        self.run_lengths = np.diff(head, append=n)
        tail = head + self.run_lengths - 1
        self.head_positions, self.tail_positions = rows[head], rows[tail]
        self.head_match = np.zeros(len(head), np.int64)
        self.tail_match = np.zeros(len(head), np.int64)
        if len(head) > 1:
            shared = self._common_prefix(rows[head[1:] - 1], rows[head[1:]])
            self.head_match[1:] = shared
            self.tail_match[:-1] = shared

    def matching_statistics(self) -> np.ndarray:
        """Per position, the longest prefix of its suffix that also starts at another position."""
        n = len(self.data)
        return np.maximum(self._stream(self.head_positions, self.head_match, n),
                          self._stream(self.tail_positions, self.tail_match, n))

    @staticmethod
    def _stream(positions, matches, n):
        """Carry each sample to the right, one shorter per step, up to the next sample."""
        source = np.zeros(n, np.int64)
        source[positions] = positions
        reach = np.zeros(n, np.int64)
        reach[positions] = positions + matches
        source = np.maximum.accumulate(source)
        return np.maximum(reach[source] - np.arange(n), 0)

    def _suffix_order(self) -> np.ndarray:
        """Suffixes sorted by prefix doubling; only rows still tied are sorted again."""
        n = len(self.data)
        end = self.ends[self.member] if n else np.zeros(0, np.int64)
        key = np.zeros(n, np.int64)
        padded = np.concatenate([self.data.astype(np.int64) + 1, np.zeros(8, np.int64)])
        at = np.arange(n)
        step = 6
        for j in range(step):
            key = key * 257 + np.where(at + j < end, padded[j:j + n], 0)
        order = np.argsort(key)
        rank = self._ranks(key[order], order, np.zeros(n, np.int64), 0)
        tied = self._ties(rank, order)
        texts = len(self.ends)
        while len(tied):
            follow = tied + step
            # past its end every text continues with a mark of its own
            second = np.where(follow < end[tied], texts + rank[np.minimum(follow, n - 1)], self.member[tied])
            both = rank[tied] * (n + texts) + second
            again = np.argsort(both)
            tied, both = tied[again], both[again]
            group = rank[tied]
            new = np.concatenate(([True], both[1:] != both[:-1]))
            lead = np.concatenate(([True], group[1:] != group[:-1]))
            start = np.maximum.accumulate(np.where(lead, np.arange(len(tied)), 0))
            place = np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))
            fresh = group + place - start
            rank[tied] = fresh
            alone = new & np.append(new[1:], True)
            tied = tied[~alone]
            step *= 2
        rows = np.empty(n, np.int64)
        rows[rank] = at
        return rows

    @staticmethod
    def _ranks(sorted_key, order, rank, base):
        lead = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1])) if len(order) else np.zeros(0, bool)
        rank[order] = base + np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))
        return rank

    @staticmethod
    def _ties(rank, order):
        r = rank[order]
        same = np.zeros(len(r), bool)
        equal = r[1:] == r[:-1]
        same[1:] |= equal
        same[:-1] |= equal
        return order[same]

    def _common_prefix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Longest common prefixes of suffix pairs, by bisection on prefix hashes."""
        n = len(self.data)
        power = powers(_BASE, n + 1)
        value = (self.data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value * power[:n], dtype=np.uint64)))
        inverse = powers(pow(_BASE, -1, 1 << 64), n + 1)
        low, high = np.zeros(len(a), np.int64), np.minimum(self.ends[self.member[a]] - a, self.ends[self.member[b]] - b)
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = (prefix[a + middle] - prefix[a]) * inverse[a] == (prefix[b + middle] - prefix[b]) * inverse[b]
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low
