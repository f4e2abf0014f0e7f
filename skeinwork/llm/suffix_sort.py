"""Two-stage suffix sorting on numpy arrays.

A suffix is of kind S if it isn't larger than its successor, else of kind L. S suffixes are sorted directly, by their first
`width` bytes; L suffixes are induced: scanning the suffix array from the left, each suffix whose predecessor is of kind L puts
that predecessor at the front of its first byte's bucket. The scan goes bucket by bucket; what a bucket's own suffixes put into
the same bucket (runs of one byte) comes in waves, each wave one array operation.

Only marked positions are sorted, and what they need: the positions behind an L position up to the next S. Order is right
for the first `width` bytes; suffixes that agree so far are next to each other, in any order.
"""

from __future__ import annotations

import numpy as np

WIDTH, ROWS = 56, 1 << 16


def kinds(text: np.ndarray) -> np.ndarray:
    """True where the suffix is of kind S; the end of the text counts as S."""
    n = len(text)
    s = np.ones(n, bool)
    if n > 1:
        step = np.sign(text[1:].astype(np.int16) - text[:-1])  # of the next byte against this one
        # a run of equal bytes has the kind that its end decides
        at = np.where(step != 0, np.arange(n - 1), n - 1)
        decide = np.minimum.accumulate(at[::-1])[::-1]
        s[:-1] = (decide == n - 1) | (step[np.minimum(decide, n - 2)] > 0)
    return s


def heads(text: np.ndarray, width: int) -> np.ndarray:
    """A view of the first `width` bytes of every suffix as fixed strings, which numpy compares byte by byte; beyond the end are
    zeros, which compare as such strings' padding does."""
    return np.ndarray((len(text),), f"S{width}", np.concatenate((text, np.zeros(width, np.uint8))), 0, (1,))


def direct(suffixes: np.ndarray, view: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Suffixes sorted by their heads, one bucket of the first byte after another."""
    order = suffixes[np.argsort(first, kind="stable")]
    ends = np.cumsum(np.bincount(first, minlength=256))
    for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        if b - a > 1:
            order[a:b] = order[a:b][np.argsort(view[order[a:b]], kind="stable")]
    return order


def needed(marked: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Marked positions and those behind marked L positions up to the next S."""
    out = marked.copy()
    at = np.flatnonzero(marked & ~s)
    while len(at):
        at = at + 1
        at = at[~out[at]]
        out[at] = True
        at = at[~s[at]]
    return out


def suffix_array(text: np.ndarray, marked: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The marked positions in the order of their suffixes (of their first `width` bytes)."""
    s = kinds(text)
    use = needed(marked, s)
    is_l = use & ~s
    small = np.flatnonzero(use & s)
    own = direct(small, heads(text, width), text[small])
    first = text[own]
    bounds = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]  # induced L suffixes of each bucket, in order

    def induce(scanned: np.ndarray, here: int) -> np.ndarray:
        """Puts the L predecessors of scanned suffixes into their buckets; returns those of this bucket."""
        before = scanned[scanned > 0] - 1
        before = before[is_l[before]]
        if not len(before):
            return before
        byte = text[before]
        by = np.argsort(byte, kind="stable")
        before, byte = before[by], byte[by]
        cuts = np.flatnonzero(np.diff(byte, prepend=byte[0])) if len(byte) else []
        mine = np.empty(0, before.dtype)
        for part in np.split(before, cuts):
            b = int(text[part[0]])
            if b == here:
                mine = part
            else:
                waiting[b].append(part)
        return mine

    out = []
    for b in range(256):
        wave = np.concatenate(waiting[b]) if waiting[b] else np.empty(0, np.int64)
        while len(wave):
            out.append(wave)
            wave = induce(wave, b)
        mine = own[bounds[b] : bounds[b + 1]]
        if len(mine):
            out.append(mine)
            induce(mine, b)
        waiting[b] = []
    order = np.concatenate(out) if out else np.empty(0, np.int64)
    return order[marked[order]]


def common_prefixes(order: np.ndarray, text: np.ndarray, most: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in the order, `most` at most; 0 for the first."""
    width = -(-most // 8) * 8
    view, out = heads(text, width), np.zeros(len(order), np.int64)
    for a in range(0, len(order), ROWS):
        b = min(len(order), a + ROWS)
        rows = view[order[max(a - 1, 0) : b]].view(">u8").reshape(-1, width // 8)
        differ = rows[1:] != rows[:-1]
        word = differ.argmax(1)
        at = np.arange(len(word))
        bits = (rows[1:][at, word] ^ rows[:-1][at, word]).astype(np.uint64)
        shared = 8 * word
        for shift in (56, 48, 40, 32, 24, 16, 8):
            shared += bits >> np.uint64(shift) == 0
        shared[~differ.any(1)] = most
        out[b - len(shared) : b] = shared
    return np.minimum(out, most)
