"""Minimal perfect hashing of 64-bit keys, with stored fingerprints, in numpy.

Levels of bits: a key owns its bit at the first level where no other remaining key falls on it; keys that collide go on to
the next level. A key's slot is the rank of its bit over all levels, so n keys get the slots 0..n-1. Lookups take a
constant number of probes on average; a 32-bit fingerprint at each slot turns unknown keys away (one in 2**32 passes).
"""

from __future__ import annotations

import io

import numpy as np

from skeinwork.llm.common import mix64

GAMMA, LEVELS = 2.0, 64
SEED = np.uint64(0x9E3779B97F4A7C15)


def _spread(keys: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(keys ^ (SEED * np.uint64(2 * level + 1)))


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_spread(keys, LEVELS) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Slots 0..n-1 for n distinct int64 keys."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, prints: np.ndarray):
        self.words, self.starts, self.prints = words, starts, prints
        self.ranks = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        own = np.ascontiguousarray(keys, np.int64).view(np.uint64)
        if len(np.unique(own)) != len(own):
            raise ValueError("keys repeat")
        rest, levels, starts = own, [], [0]
        for level in range(LEVELS):
            if not len(rest):
                break
            size = max(64, int(GAMMA * len(rest)) + 63 & ~63)
            at = (_spread(rest, level) % np.uint64(size)).astype(np.int64)
            taken = np.bincount(at, minlength=size)
            levels.append(np.packbits(taken == 1, bitorder="little").view(np.uint64))
            starts.append(starts[-1] + size)
            rest = rest[taken[at] > 1]
        if len(rest):
            raise ValueError("no level separates these keys")
        words = np.concatenate(levels) if levels else np.empty(0, np.uint64)
        made = cls(words, np.array(starts, np.int64), np.zeros(len(own), np.uint32))
        made.prints[made._slots(own)] = _fingerprint(own)
        return made

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        found, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level in range(len(self.starts) - 1):
            if not len(open_):
                break
            size = self.starts[level + 1] - self.starts[level]
            bit = self.starts[level] + (_spread(keys[open_], level) % np.uint64(size)).astype(np.int64)
            word, low = self.words[bit >> 6], (bit & 63).astype(np.uint64)
            hit = (word >> low & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << low) - np.uint64(1)))
            found[open_[hit]] = (self.ranks[bit >> 6] + below)[hit]
            open_ = open_[~hit]
        return found

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that weren't there."""
        own = np.ascontiguousarray(keys, np.int64).view(np.uint64)
        slots = self._slots(own)
        ok = slots >= 0
        ok[ok] = self.prints[slots[ok]] == _fingerprint(own[ok])
        return np.where(ok, slots, -1)

    def arrays(self) -> dict[str, np.ndarray]:
        return {"words": self.words, "starts": self.starts, "prints": self.prints}


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpacked(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob)) as found:
        return {k: found[k] for k in found.files}
