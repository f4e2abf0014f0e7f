"""Vectorised segments of text bytes: word and chunk bounds, 64-bit hashes of segments, distinct segments of a slice."""

from __future__ import annotations

import numpy as np

from skeinwork.llm.common import mix64

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _random(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64((np.arange(n, dtype=np.uint64) + np.uint64(1)) * _GOLD + np.uint64(seed)) | np.uint64(1)


_BYTE = [_random(256, 1 << 40), _random(256, 1 << 41)]
_PLACE = [_random(1 << 12, 1 << 42), _random(1 << 12, 1 << 43)]


def _places(n: int, kind: int) -> np.ndarray:
    if n > len(_PLACE[kind]):
        _PLACE[kind] = _random(max(n, 2 * len(_PLACE[kind])), 1 << 42 + kind)
    return _PLACE[kind]


def hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each segment data[start:start+length]; the same bytes give the same hash wherever they stand."""
    return _hashes(data, starts, lengths, (0,))[0]


def _hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, which: tuple[int, ...]) -> list[np.ndarray]:
    """One or two independent hashes of each segment; they share the work of finding each byte's place."""
    out = [np.zeros(len(starts), np.uint64) for _ in which]
    full = lengths > 0
    s, n = starts[full], lengths[full]
    if not len(s):
        return out
    ends = np.cumsum(n)
    kind = np.int32 if ends[-1] < 1 << 31 else np.int64
    place = np.arange(ends[-1], dtype=kind) - np.repeat((ends - n).astype(kind), n)
    bytes_ = data if _contiguous(s, n, len(data)) else data[np.repeat(s, n) + place]
    size = n.astype(np.uint64) * _GOLD
    with np.errstate(over="ignore"):
        for k, h in zip(which, out, strict=True):
            terms = _BYTE[k][bytes_]
            terms *= _places(int(n.max()), k)[place]
            h[full] = mix64(np.add.reduceat(terms, ends - n) ^ size)
    return out


def _contiguous(s: np.ndarray, n: np.ndarray, size: int) -> bool:
    return s[0] == 0 and s[-1] + n[-1] == size and bool(np.all(s[1:] == s[:-1] + n[:-1]))


def runs(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that don't cross an offset, and the number of runs before each offset."""
    n = len(mask)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offs), np.int64)
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    inner = offs[:-1][offs[:-1] < n]
    first[inner] = mask[inner]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    ends = offs[1:][offs[1:] > 0] - 1
    last[ends] = mask[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True  # ASCII that isn't white space
_LEAD2 = np.zeros(256, bool)
_LEAD2[0xC3:0xE0] = True  # leads of two-byte letters; no white space among them
_NEXT = _PLAIN | _LEAD2
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_MARK = _PLAIN & ~_LETTER  # ASCII marks, but for digits and the apostrophe that begins contractions
_MARK[0x30:0x3A] = _MARK[0x27] = False


def chunk_starts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Starts of chunks, at places that pre-tokens of the byte-level pattern never span, so texts can be tokenized chunk
    by chunk: each text's start; a single space or line end between two characters that surely aren't white space, and
    what follows that line end; changes from an ASCII letter to an ASCII mark and back."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    if n > 2:
        for gap, after in ((0x20, False), (0x0A, True)):
            at = np.flatnonzero(data[1:-1] == gap) + 1
            before = data[at - 1]
            ok = (_PLAIN[before] | (before >= 0x80) & _LEAD2[data[np.maximum(at - 2, 0)]] & (at >= 2)) & _NEXT[data[at + 1]]
            cut[at[ok]] = True
            if after:
                cut[at[ok] + 1] = True
        mark, letter = _MARK[data], _LETTER[data]
        cut[1:n] |= letter[:-1] & mark[1:] | mark[:-1] & letter[1:]
    return np.flatnonzero(cut[:n])


def distinct(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct segments, and for each segment which of them it is. Two hashes, 128 bits, tell segments apart."""
    a, b = _hashes(data, starts, lengths, (0, 1))
    order = np.argsort(a, kind="stable")
    new = np.ones(len(a), bool)
    new[1:] = a[order][1:] != a[order][:-1]
    b = b[order]
    if np.any((b[1:] != b[:-1]) & ~new[1:]):
        body = data.tobytes()
        seen: dict[bytes, int] = {}
        of = np.array([seen.setdefault(body[s : s + n], len(seen)) for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)], np.int64)
        return list(seen), of
    of = np.empty(len(a), np.int64)
    of[order] = np.cumsum(new) - 1
    body, one = data.tobytes(), order[new]
    return [body[s:e] for s, e in zip(starts[one].tolist(), (starts[one] + lengths[one]).tolist(), strict=True)], of


def gather(offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the elements of ragged pieces, one piece after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets - (ends - lengths), lengths)
