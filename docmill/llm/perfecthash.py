"""A minimal perfect hash function in numpy arrays."""

from __future__ import annotations

import numpy as np

from docmill.llm.textkernel import mix

SPREAD = 2.0  # slots per key and level
LEVELS = 24


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: bit arrays by level, positions by rank.

    A key sits at the first level where no other key shares its slot. Keys
    left after the last level (equal ones only, in practice) are listed.
    """

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.ranks = [np.concatenate([[0], np.cumsum(x)]) for x in levels]
        self.firsts = np.cumsum([0, *(int(x.sum()) for x in levels)])

    @staticmethod
    def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys) and len(levels) < LEVELS:
            size = max(8, int(SPREAD * len(keys)))
            slot = cls._slot(keys, len(levels), size)
            alone = np.bincount(slot, minlength=size) == 1
            levels.append(alone)
            keys = keys[~alone[slot]]
        return cls(levels, np.sort(keys))

    def positions(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key; -1 for keys that surely weren't built in (others may get any position)."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for k, (bits, rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            slot = self._slot(keys[left], k, len(bits))
            here = bits[slot]
            out[left[here]] = self.firsts[k] + rank[slot[here]]
            left = left[~here]
        return out
