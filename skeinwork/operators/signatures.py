"""Signatures of 64 bits that are near: dealt to parts by bits that must be equal, and joined there by arrays.

Of distance + 1 bands of two signatures within the distance, one is equal. So a row goes to one part for each band, as often at
any size of the table; flips are tried within a part only, where they cost no shuffled row."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Core seconds of a flip tried, of a row that tries it, of a row that it finds, and of a comparison of all with all.
FLIP, PROBE, FOUND, COMPARED = 6e-5, 8e-9, 1.2e-8, 3e-9
#: Rows that are dealt out at once, rows of a part that bands aim at and that tiles hold, pairs of one batch, cells of one array.
DEALT, PART, TILE, BATCH, CELLS = 1 << 18, 1 << 16, 1 << 19, 1 << 17, 1 << 18


class Deal:
    """Bands of `width` bits that rows are dealt by, and the tiles that each part is cut into; no width: one part."""

    def __init__(self, distance: int, width: int):
        self.width, n = width, distance + 1 if width else 1
        self.shift = [64 - 64 * k // n - width for k in range(n)]
        self.tiles = np.ones(n << width, np.int64)

    @property
    def most(self) -> int:
        return int(self.tiles.max())

    def parts(self, band: int, sig: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(sig), np.int64)
        return (sig >> np.uint64(self.shift[band]) & np.uint64((1 << self.width) - 1)).astype(np.int64) | band << self.width

    def turned(self, band: int, x: np.ndarray) -> np.ndarray:
        """Bits turned so that the band's are the highest."""
        left = 64 * band // len(self.shift)
        return x << np.uint64(left) | x >> np.uint64(64 - left) if left else x

    def before(self, band: int) -> list[int]:
        """Turned masks of the bands before it."""
        masks = np.array([((1 << self.width) - 1) << s for s in self.shift[:band]], np.uint64)
        return [int(m) for m in self.turned(band, masks)]


def widest(distance: int) -> int:
    """Bits of a band that counts are taken of; 0 if bands are too narrow to be of use."""
    return w if (w := min(12, 64 // (distance + 1))) >= 4 else 0


def deal(rows: DataFrame, distance: int) -> tuple[Deal, int]:
    """How to deal out rows (sig) so that a tile is bounded whatever the bits are, and the number of rows."""
    import pyarrow as pa

    finest = Deal(distance, widest(distance))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(finest.tiles), np.int64)
        for batch in batches:
            sig = batch.column(0).to_numpy().view(np.uint64)
            for band in range(len(finest.shift)):
                n += np.bincount(finest.parts(band, sig), minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["part", "n"])

    n = np.zeros(len(finest.tiles), np.int64)
    for part, rows_of in rows.select("sig").mapInArrow(count, "part long, n long").groupBy("part").agg(F.sum("n")).collect():
        n[part] = rows_of
    total = int(n[: 1 << finest.width].sum())
    width = min(finest.width, max(3, (max(0, total - 1) // PART).bit_length())) if finest.width else 0
    dealt = Deal(distance, width)
    dealt.tiles = np.maximum(1, -(-n.reshape(len(dealt.tiles), -1).sum(1) // TILE))
    return dealt, total


def dealt_out(rows: DataFrame, names: list[str], how: Deal) -> DataFrame:
    """key, side and arrays of rows (names, sig, mix): of each part, or of two of its tiles that meet."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def told() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            sig, mix = table.column("sig").to_numpy().view(np.uint64), table.column("mix").to_numpy().view(np.uint64)
            columns = [table.column(c).combine_chunks() for c in ("sig", *names)]
            for band in range(len(how.shift)):
                part = how.parts(band, sig)
                tiles = how.tiles[part]
                tile = (mix % tiles.astype(np.uint64)).astype(np.int64)
                for other in range(int(tiles.max())):
                    at = np.flatnonzero(tiles > other)
                    key = (part[at] * how.most + np.minimum(tile[at], other)) * how.most + np.maximum(tile[at], other)
                    key = key * 2 + (tile[at] > other)
                    by = np.argsort(key, kind="stable")
                    key, at = key[by], pa.array(at[by])
                    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                    ends = pa.array(np.r_[first, len(key)].astype(np.int32))
                    lists = [pa.ListArray.from_arrays(ends, c.take(at)) for c in columns]
                    yield pa.RecordBatch.from_arrays([pa.array(key[first] >> 1), pa.array((key[first] & 1).astype(np.int32)), *lists], ["key", "side", "sig", *names])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= DEALT:
                yield from told()
                held.clear()
        if sum(b.num_rows for b in held):
            yield from told()

    kinds = ", ".join(f"`{c}` array<{rows.schema[c].dataType.simpleString()}>" for c in names)
    return rows.select("sig", "mix", *names).mapInArrow(run, f"key long, side int, sig array<long>, {kinds}")


@lru_cache(maxsize=256)
def flips(width: int, radius: int, need: tuple[int, ...] = ()) -> list[int]:
    """What up to `radius` of the bits differ by, with one bit at least in each of the masks."""
    found = (sum(1 << k for k in c) for r in range(radius + 1) for c in combinations(range(width), r))
    return [f for f in found if all(f & m for m in need)]


@lru_cache(maxsize=4096)
def bands_within(p: int, q: int, same: bool, distance: int, bits: int) -> tuple[tuple[int, int, int], ...]:
    """Shift, width, radius of the bands of the lower `bits` that find the near pairs of p and q rows with the least work, were
    the bits random; none: compare all with all."""
    best, least = (), COMPARED * p * q / (1 + same)
    for m in range(1, distance + 2):
        more, some = divmod(distance - m + 1, m)
        radii = [more + (k < some) for k in range(m)]
        for w in range(radii[0] + 1, min(bits // m, 20) + 1):
            tried = sum(comb(w, k) for r in radii for k in range(r + 1))
            work = tried * (FLIP + p * (PROBE + FOUND * q / 2**w) / (1 + same)) + m * (1e-7 * (p + q) + 1e-8 * 2**w)
            if work < least:
                best, least = tuple((bits - bits * k // m - w, w, r) for k, r in enumerate(radii)), work
    return best


def near(left: np.ndarray, rows: np.ndarray, right: np.ndarray, start: np.ndarray, n: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of near signatures among left[rows] and the n of right from start on, one array of bounded size at a time."""
    some = np.flatnonzero(n > 0)
    rows, start, n = rows[some], start[some], n[some]
    own = left[rows]
    while len(rows):
        if int(n.max()) > 2 * len(rows):  # few rows and many to compare them with
            for i, x, s, c in zip(rows.tolist(), own, start.tolist(), n.tolist(), strict=True):
                for at in range(s, s + c, CELLS):
                    j = np.flatnonzero(np.bitwise_count(right[at : min(at + CELLS, s + c)] ^ x) <= distance)
                    if len(j):
                        yield np.full(len(j), i), j + at
            return
        hit = np.flatnonzero(np.bitwise_count(own ^ right[start]) <= distance)
        if len(hit):
            yield rows[hit], start[hit]
        some = np.flatnonzero(n > 1)
        rows, start, n, own = rows[some], start[some] + 1, n[some] - 1, own[some]


class Sorted:
    """Signatures in the order of a band's bits, and where each value begins."""

    def __init__(self, sig: np.ndarray, shift: int, width: int):
        value = (sig >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.int32)
        self.order = np.argsort(value, kind="stable")
        self.value, self.sig, self.width = value[self.order], sig[self.order], width
        self.start = np.r_[0, np.cumsum(np.bincount(value, minlength=1 << width))].astype(np.int32)
        self._low: dict[int, np.ndarray] = {}

    def low(self, bit: int) -> np.ndarray:
        """Places whose value lacks the bit."""
        if bit not in self._low:
            self._low[bit] = np.flatnonzero(self.value >> bit & 1 == 0)
        return self._low[bit]

    def met(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = self.start[value]
        return start, self.start[value + 1] - start


def own_pairs(s: Sorted, flip: int, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of near rows of one table whose values differ by the flip, each pair once."""
    if flip:
        rows = s.low(flip.bit_length() - 1)
        yield from near(s.sig, rows, s.sig, *s.met(s.value[rows] ^ flip), distance)
    else:
        rows = np.arange(len(s.sig))
        yield from near(s.sig, rows, s.sig, rows + 1, s.start[s.value + 1] - rows - 1, distance)


def pairs(left: np.ndarray, right: np.ndarray | None, distance: int, bits: int, masks: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places and distances of all near pairs of left and right, or of left itself, that differ in all masks, each once."""
    same = right is None
    other = left if right is None else right
    bands = bands_within(len(left), len(other), same, distance, bits)

    def told(band: int, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = left[p] ^ other[q]
        keep = np.ones(len(x), bool)
        for m in masks:
            keep &= x & np.uint64(m) != 0
        for shift, width, radius in bands[:band]:
            keep &= np.bitwise_count(x >> np.uint64(shift) & np.uint64((1 << width) - 1)) > radius
        return p[keep], q[keep], np.bitwise_count(x[keep])

    if not bands:
        rows = np.arange(len(left))
        start, n = (rows + 1, len(left) - 1 - rows) if same else (np.zeros_like(rows), np.full(len(left), len(other)))
        for i in range(0, len(rows), 64):  # few rows at a time, so that each is compared with a run of the others
            for p, q in near(left, rows[i : i + 64], other, start[i : i + 64], n[i : i + 64], distance):
                yield told(0, p, q)
    for k, (shift, width, radius) in enumerate(bands):
        a = Sorted(left, shift, width)
        b = a if same else Sorted(other, shift, width)
        for flip in flips(width, radius, _needed(masks, shift, width)):
            for p, q in own_pairs(a, flip, distance) if same else near(a.sig, np.arange(len(left)), b.sig, *b.met(a.value ^ flip), distance):
                yield told(k, a.order[p], b.order[q])


def _needed(masks: list[int], shift: int, width: int) -> tuple[int, ...]:
    """Of the masks those that lie within the band."""
    return tuple(m >> shift for m in masks if not m & ~(((1 << width) - 1) << shift))


class Forest:
    """Which places are connected; of the edges told it, those that connected something."""

    def __init__(self, n: int):
        self.root, self.waiting, self.n_waiting = np.arange(n), [], 0
        self.major, self.rest = 0, None

    def add(self, p: np.ndarray, q: np.ndarray) -> None:
        keep = self.root[p] != self.root[q]
        if keep.any():
            self.waiting.append((p[keep], q[keep]))
            self.n_waiting += int(keep.sum())

    def merged(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not self.waiting:
            return
        p, q = (np.concatenate(c) for c in zip(*self.waiting, strict=True))
        self.waiting, self.n_waiting = [], 0
        while len(p):
            a, b = self.root[p], self.root[q]
            keep = a != b
            p, q, a, b = p[keep], q[keep], a[keep], b[keep]
            high, first = np.unique(np.maximum(a, b), return_index=True)
            if len(high):
                yield p[first], q[first]
            self.root[high] = np.minimum(a, b)[first]
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up
        sizes = np.bincount(self.root)
        self.major = int(sizes.argmax())
        self.rest = np.flatnonzero(self.root != self.major) if 2 * sizes[self.major] > len(self.root) else None


def forest(sig: np.ndarray, distance: int, bits: int, masks: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs that connect whatever near pairs that differ in all masks connect, fewer than rows. Neighbours in a few sorted
    orders connect crowds; from then on, if most rows are connected, only the others look for near rows."""
    n, found = len(sig), Forest(len(sig))
    for turn in range(0, 64, 8):
        order = np.argsort(sig << np.uint64(turn) | sig >> np.uint64(64 - turn) if turn else sig)
        for gap in (1, 2, 4):
            p, q = order[:-gap], order[gap:]
            close = np.bitwise_count(sig[p] ^ sig[q]) <= distance
            found.add(p[close], q[close])
        if 50 * found.n_waiting < n:
            yield from found.merged()
            break
        yield from found.merged()
    bands = bands_within(n, n, True, distance, bits)
    for shift, width, radius in bands or ((0, 1, 1),):
        s = Sorted(sig, shift, width)
        for flip in flips(width, radius, _needed(masks, shift, width)):
            if found.rest is None:
                met = own_pairs(s, flip, distance)
            elif len(found.rest):
                value = (sig[found.rest] >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.int32)
                met = ((p, q) for p, q in near(sig, found.rest, s.sig, *s.met(value ^ flip), distance))
            else:
                return
            own = found.rest is None
            for p, q in met:
                found.add(s.order[p] if own else p, s.order[q])
                if 8 * found.n_waiting >= n:
                    yield from found.merged()
            if found.rest is not None and 4 * found.n_waiting >= len(found.rest):
                yield from found.merged()
        yield from found.merged()


def joined(dealt: DataFrame, names: list[str], kinds: dict[str, str], distance: int, how: Deal, connect: bool) -> DataFrame:
    """name_a, name_b of near rows and their distance: all pairs, of different groups if a second name tells them; or, to
    connect them, a forest of them."""
    import pyarrow as pa

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, low, top = key[0].as_py() // how.most**2, key[0].as_py() // how.most % how.most, key[0].as_py() % how.most
        band = part >> how.width
        table = pa.Table.from_batches(list(batches))
        n = np.repeat(table.column("side").to_numpy(), table.column("sig").combine_chunks().value_lengths().to_numpy())
        columns = {c: table.column(c).combine_chunks().flatten() for c in ("sig", *names)}
        sig = how.turned(band, columns["sig"].to_numpy().view(np.uint64))
        group = columns[names[1]].dictionary_encode().indices.to_numpy() if len(names) > 1 else None
        bits, masks = 64 - how.width, how.before(band)
        if connect:
            met: Iterator[tuple] = ((p, q, np.bitwise_count(sig[p] ^ sig[q])) for p, q in forest(sig, distance, bits, masks))
        elif low == top:
            met = pairs(sig, None, distance, bits, masks)
        else:
            a, b = np.flatnonzero(n == 0), np.flatnonzero(n == 1)
            met = ((a[p], b[q], d) for p, q, d in pairs(sig[a], sig[b], distance, bits, masks)) if len(a) and len(b) else iter(())
        yield from _batches(met, columns, names, group)

    run.__annotations__ = {"key": tuple, "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    schema = ", ".join([*(f"`{c}_{s}` {k}" for c, k in kinds.items() for s in "ab"), "distance int"])
    tasks = int((how.tiles * (how.tiles + 1) // 2).sum())
    return dealt.repartition(min(tasks, 4096), "key").groupBy("key").applyInArrow(run, schema)


def _batches(met: Iterator[tuple], columns: dict, names: list[str], group: np.ndarray | None) -> Iterator:
    import pyarrow as pa

    held: list[tuple] = []
    n = 0

    def told() -> pa.RecordBatch:
        p, q, d = (np.concatenate(c) for c in zip(*held, strict=True))
        ids = [(columns[c].take(pa.array(at)), f"{c}_{s}") for c in names for at, s in ((p, "a"), (q, "b"))]
        return pa.RecordBatch.from_arrays([*(c for c, _ in ids), pa.array(d.astype(np.int32))], [*(name for _, name in ids), "distance"])

    for p, q, d in met:
        if group is not None:
            keep = group[p] != group[q]
            p, q, d = p[keep], q[keep], d[keep]
        if len(p):
            held.append((p, q, d))
            n += len(p)
        if n >= BATCH:
            yield told()
            held.clear()
            n = 0
    if held:
        yield told()
