"""A linear-chain conditional random field with two labels, over many sequences at once.

Scores are ratios of label 1 to label 0, so forward and backward passes are one number per place.
Sequences lie side by side, longest first; every step works on those that are that long.
"""

from __future__ import annotations

import numpy as np

_LIMIT = 30.0


class ChainField:
    """Emission weights ``theta`` (bias, then one per feature value) and transition weights."""

    def __init__(self, features: int):
        self.theta = np.zeros(features + 1)
        self.theta[0] = -4.0
        self.step = np.zeros(3)  # 0 to 1, 1 to 0, 1 to 1; 0 to 0 is fixed at zero

    def passes(self, emission: np.ndarray, lengths: np.ndarray):
        """Forward and backward ratios; ``emission`` is place by sequence, lengths descend."""
        size = len(emission)
        up, out, stay = np.exp(self.step)
        odds = np.exp(np.clip(emission, -_LIMIT, _LIMIT))
        active = np.searchsorted(-lengths, -np.arange(size), "left")
        forward, backward = np.ones_like(odds), np.ones_like(odds)
        if size:
            forward[0] = odds[0]
        for t in range(1, size):
            n = active[t]
            r = forward[t - 1, :n]
            forward[t, :n] = odds[t, :n] * (up + r * stay) / (1 + r * out)
        for t in range(size - 2, -1, -1):
            n = active[t + 1]
            x = odds[t + 1, :n] * backward[t + 1, :n]
            backward[t, :n] = (out + stay * x) / (1 + up * x)
        return odds, forward, backward

    def marginals(self, emission: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        _, forward, backward = self.passes(emission, lengths)
        ratio = forward * backward
        return ratio / (1 + ratio)

    def fit(self, bins: np.ndarray, labels: np.ndarray, lengths: np.ndarray, rounds: int = 150, rate: float = 0.15,
            ridge: float = 1.0, lanes: int = 1024) -> None:
        """Adam on the likelihood; ``bins`` is place by sequence by kind, each a feature value from 1, in one byte.

        Expectations are added up over ``lanes`` sequences at a time, so besides the input only grids of that
        width are held.
        """
        blocks = []
        for a in range(0, len(lengths), lanes):
            size = int(lengths[a])
            inside = np.arange(size)[:, None] < lengths[None, a:a + lanes]
            blocks.append((bins[:size, a:a + lanes], labels[:size, a:a + lanes], lengths[a:a + lanes], inside))
        seen, moved = np.zeros_like(self.theta), np.zeros(3)
        for part, tags, _, inside in blocks:
            one = (tags == 1) & inside
            seen[0] += one.sum()
            for kind in range(part.shape[2]):
                seen += np.bincount(part[..., kind][one], minlength=len(seen))
            both = inside[1:]
            before, after = tags[:-1][both], tags[1:][both]
            moved += [((before == 0) & (after == 1)).sum(), ((before == 1) & (after == 0)).sum(),
                      ((before == 1) & (after == 1)).sum()]
        first, second = np.zeros(len(seen) + 3), np.zeros(len(seen) + 3)
        for i in range(1, rounds + 1):
            expected, steps = np.zeros_like(self.theta), np.zeros(3)
            for part, _, sizes, inside in blocks:
                self._expect(part, sizes, inside, expected, steps)
            slope = np.concatenate((seen - expected, moved - steps)) - ridge * np.concatenate((self.theta, self.step))
            slope[0] += ridge * self.theta[0]
            first = 0.9 * first + 0.1 * slope
            second = 0.99 * second + 0.01 * slope * slope
            move = rate * (first / (1 - 0.9 ** i)) / (np.sqrt(second / (1 - 0.99 ** i)) + 1e-9)
            self.theta += move[:-3]
            self.step += move[-3:]

    def _expect(self, bins, lengths, inside, expected: np.ndarray, steps: np.ndarray) -> None:
        """Adds the expected features and moves of some sequences."""
        odds, forward, backward = self.passes(self.emission(bins), lengths)
        ratio = forward * backward
        p = np.where(inside, ratio / (1 + ratio), 0)
        expected[0] += p.sum()
        for kind in range(bins.shape[2]):
            expected += np.bincount(bins[..., kind].ravel(), p.ravel(), len(expected))
        up, out, stay = np.exp(self.step)
        r, x = forward[:-1], odds[1:] * backward[1:]
        parts = [up * x, r * out, r * stay * x]
        whole = 1 + parts[0] + parts[1] + parts[2]
        steps += [(part / whole)[inside[1:]].sum() for part in parts]

    def emission(self, bins: np.ndarray) -> np.ndarray:
        weights = self.theta.copy()
        weights[0] = 0.0  # no feature
        return self.theta[0] + sum(weights[bins[..., k]] for k in range(bins.shape[-1]))
