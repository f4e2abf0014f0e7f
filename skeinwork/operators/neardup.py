"""Near duplicates by 64-bit signatures, and the groups they connect."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.operators import signatures as near
from skeinwork.session import checkpointed


#: Core seconds of a comparison, of a row dealt out once, and of a pair of buckets that meet.
COMPARISON, DEALT, MEETING = 3e-9, 2e-6, 3e-5
#: Rows of a part from where on it is cut into tiles, comparisons of one array operation, pairs of one batch.
TILE, CELLS, BATCH = 1 << 19, 1 << 18, 1 << 17
#: Rows up to which pairs are found without dealing by equal bands.
FEW = 1 << 13


class Bands:
    """Bands of `width` bits with the flips each allows: of rows within the distance, some band differs by its radius at most
    (the radii add up to distance - bands + 1). One band of no bits compares all rows with all."""

    def __init__(self, distance: int, n_bands: int, width: int, n: int):
        more, some = divmod(max(0, distance - n_bands + 1), n_bands)
        self.width, self.radius = width, [min(width, more + (k < some)) for k in range(n_bands)]
        self.shift = [64 - 64 * k // n_bands - width for k in range(n_bands)]
        #: Rows are dealt to parts by a band's first bits: to their own part, and to those before it within the radius.
        self.high = min(width, max(6 - (n_bands.bit_length() - 1), (n >> 17).bit_length()))

    def balls(self, bits: int) -> list[int]:
        return [sum(comb(bits, k) for k in range(r + 1)) for r in self.radius]

    def work(self, n: int) -> float:
        """Core seconds for n rows of random bits."""
        met, dealt = sum(self.balls(self.width)) / 2, sum((b + 1) / 2 for b in self.balls(self.high))
        return COMPARISON * n * n * met / 2**self.width + DEALT * n * (dealt if self.width else n / _tile(n)) + MEETING * min(2**self.width, n) * met


def _tile(n: int) -> int:
    """Rows of a tile where all rows are one part: 16 tiles, of bounded size."""
    return max(1 << 11, min(1 << 16, -(-n // 16)))


def bands_for(n: int, distance: int, n_bands: int | None = None) -> Bands:
    """The bands that make the least work, were the bits random."""
    ways = range(1, distance + 2) if n_bands is None else [n_bands]
    each = (Bands(distance, m, w, n) for m in ways for w in range(min(64 // m, 20) + 1) if w or m == 1)
    return min((b for b in each if not b.width or max(b.radius) < b.width), key=lambda b: b.work(n))


def _flips(bits: int, radius: int) -> list[int]:
    return [sum(1 << k for k in c) for r in range(radius + 1) for c in combinations(range(bits), r)]


def _blocks(a: np.ndarray, b: np.ndarray, distance: int, triangle: bool, x: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in a and b, and distance, of signatures within the distance, a bounded block at a time; of a triangle (a is b)
    only those with the first place before the second. x and n: room for a block's comparisons."""
    wide = min(len(b), 4096, len(x))
    tall = max(1, len(x) // max(1, wide))
    for i in range(0, len(a), tall):
        for j in range(i if triangle else 0, len(b), wide):
            left, right = a[i : i + tall], b[j : j + wide]
            shape, size = (len(left), len(right)), len(left) * len(right)
            np.bitwise_xor(left[:, None], right, out=x[:size].reshape(shape))
            np.bitwise_count(x[:size], out=n[:size])
            if n[:size].min() <= distance:
                near = np.flatnonzero(n[:size] <= distance)
                p, q = near // len(right) + i, near % len(right) + j
                if triangle:
                    p, q, near = (c[p < q] for c in (p, q, near))
                yield p, q, n[near]


def _compared(bands: Bands, distance: int, names: list[str]):
    """The pairs of a part's two tiles (or of one), each told by the first band that it is near in."""
    import pyarrow as pa

    def first(band: int, x: np.ndarray) -> np.ndarray:
        before = np.zeros(len(x), bool)
        for shift, radius in zip(bands.shift[:band], bands.radius[:band]):
            before |= np.bitwise_count(x >> np.uint64(shift) & np.uint64((1 << bands.width) - 1)) <= radius
        return ~before

    def meetings(band: int, part: int, left: np.ndarray, right: np.ndarray, same: bool) -> Iterator[tuple]:
        """Runs of left and right whose bits in the band are within the radius, the smaller of this part."""
        u, a, n = np.unique(left, return_index=True, return_counts=True)
        v, b, m = np.unique(right, return_index=True, return_counts=True)
        for flip in _flips(bands.width, bands.radius[band]) if len(v) else []:
            other = u ^ flip
            at = np.minimum(np.searchsorted(v, other), len(v) - 1)
            meets = (v[at] == other) & (np.minimum(u, other) >> (bands.width - bands.high) == part)
            for k in np.flatnonzero(meets & (other >= u) if same else meets).tolist():
                yield slice(a[k], a[k] + n[k]), slice(b[at[k]], b[at[k]] + m[at[k]]), same and not flip

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (band, part), same = divmod(key[0].as_py(), 1 << bands.high), key[1].as_py() == key[2].as_py()
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        sig = table.column("sig").to_numpy().view(np.uint64)
        value = (sig >> np.uint64(bands.shift[band]) & np.uint64((1 << bands.width) - 1)).astype(np.int64) if bands.width else np.zeros(len(sig), np.int64)
        kind = table.column(names[1]).combine_chunks().dictionary_encode() if len(names) > 1 else None
        kind = kind.indices.to_numpy() if kind is not None else None
        by = np.argsort(value, kind="stable")
        side = table.column("side").to_numpy()[by]
        left, right = (by, by) if same else (by[side == 0], by[side == 1])
        held: list[tuple] = []
        room = np.empty(CELLS, np.uint64), np.empty(CELLS, np.uint8)

        def told() -> pa.RecordBatch:
            p, q, d = (np.concatenate(c) for c in zip(*held, strict=True))
            ids = [(table.column(c).combine_chunks().take(pa.array(at)), f"{c}_{s}") for c in names for at, s in ((p, "a"), (q, "b"))]
            return pa.RecordBatch.from_arrays([*(c for c, _ in ids), pa.array(d.astype(np.int32))], [*(name for _, name in ids), "distance"])

        for s, t, triangle in meetings(band, part, value[left], value[right], same):
            own, others = left[s], right[t]
            for p, q, d in _blocks(sig[own], sig[others], distance, triangle, *room):
                p, q = own[p], others[q]
                keep = first(band, sig[p] ^ sig[q])
                if kind is not None:
                    keep &= kind[p] != kind[q]
                if keep.any():
                    held.append((p[keep], q[keep], d[keep]))
                    if sum(len(h[0]) for h in held) >= BATCH:
                        yield told()
                        held.clear()
        if held:
            yield told()

    run.__annotations__ = {"key": tuple, "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return run


def hamming_pairs(signatures: DataFrame, id_: str, distance: int, group: str | None = None, n_bands: int | None = None, width: int | None = None) -> DataFrame:
    """id_a < id_b, distance of all pairs within the distance (of different groups, if a group column is given).

    Rows are dealt to parts by distance + 1 bands of which one must be equal (`signatures`). Few rows, distances that leave
    such bands under four bits, and given bands: by the first bits of each band (see Bands), where they are compared with those
    whose whole band is within its radius, by arrays. Parts of more than TILE rows are cut into tiles that meet in tasks of their
    own, so that neither many copies nor frequent bits make one large task, and a task holds two tiles at most."""
    names = [id_, *([group] if group else [])]
    rows = _told(signatures, names)
    kinds = {c: signatures.schema[c].dataType.simpleString() for c in names}
    if n_bands is None and width is None and near.widest(distance):
        how, n = near.deal(rows, distance)
        if n > FEW:
            return _in_order(_joined(rows, names, kinds, distance, how, False), id_, group)
    else:
        n = signatures.count()
    bands = bands_for(n, distance, n_bands) if width is None else Bands(distance, n_bands, width, n)

    def parts_of(band: int) -> Column:
        top = F.shiftrightunsigned("sig", bands.shift[band] + bands.width - bands.high).bitwiseAND(F.lit((1 << bands.high) - 1)) if bands.high else F.lit(0).cast("long")
        near = F.transform(F.array(*(F.lit(x).cast("long") for x in _flips(bands.high, bands.radius[band]))), lambda flip: top.bitwiseXOR(flip))
        return F.transform(F.filter(near, lambda part: part <= top), lambda part: part + (band << bands.high))

    rows = rows.withColumn("part", F.explode(F.concat(*(parts_of(k) for k in range(len(bands.radius))))))
    if bands.width:
        parts = rows.groupBy("part").agg(F.count("*").alias("n"))
        tiles = F.ceil(F.col("n") / TILE).cast("int")
        total = parts.agg(F.sum(F.col("n") * tiles), F.sum(tiles * (tiles + 1) / 2), F.max(tiles)).first()
        rows = rows.join(F.broadcast(parts.where(F.col("n") > TILE).select("part", tiles.alias("tiles"))), "part", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1))) if (total[2] or 1) > 1 else rows.withColumn("tiles", F.lit(1))
    else:
        cut = max(1, -(-n // _tile(n)))
        total, rows = (n * cut, cut * (cut + 1) // 2), rows.withColumn("tiles", F.lit(cut))
    rows = rows.withColumn("tile", F.pmod(F.xxhash64(id_, "sig"), "tiles").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    keys = [F.col("part"), F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("top")]
    rows = rows.select(*keys, (F.col("tile") > F.col("other")).cast("int").alias("side"), "sig", *names)
    n_tasks = int(max(1, min(total[1] or 1, max(200, (total[0] or 0) >> 18))))
    schema = ", ".join([*(f"`{c}_{s}` {k}" for c, k in kinds.items() for s in "ab"), "distance int"])
    found = rows.repartition(n_tasks, "part", "low", "top").groupBy("part", "low", "top").applyInArrow(_compared(bands, distance, names), schema)
    return _in_order(found, id_, group)


def _told(signatures: DataFrame, names: list[str]) -> DataFrame:
    """Rows that have all names and a signature, as one number."""
    sig = F.shiftleft("sig_hi", 32).bitwiseOR(F.col("sig_lo").bitwiseAND(F.lit(0xFFFFFFFF)))
    return signatures.where(" and ".join(f"`{c}` is not null" for c in (*names, "sig_hi", "sig_lo"))).select(*names, sig.alias("sig"))


def _joined(rows: DataFrame, names: list[str], kinds: dict[str, str], distance: int, how: near.Deal, connect: bool) -> DataFrame:
    dealt = near.dealt_out(rows.withColumn("mix", F.xxhash64(names[0], "sig")), names, how)
    return near.joined(dealt, names, kinds, distance, how, connect)


def _in_order(found: DataFrame, id_: str, group: str | None) -> DataFrame:
    """The smaller row of each pair first; no row with its like."""
    ordered = F.col(f"{id_}_a") < F.col(f"{id_}_b")
    pick = lambda c, x, y: F.when(ordered, F.col(f"{c}_{x}")).otherwise(F.col(f"{c}_{y}"))
    out = [pick(id_, "a", "b").alias(f"{id_}_a"), pick(id_, "b", "a").alias(f"{id_}_b"), F.col("distance"), *([pick(group, "a", "b").alias(f"{group}_a"), pick(group, "b", "a").alias(f"{group}_b")] if group else [])]
    return found.where(F.col(f"{id_}_a") != F.col(f"{id_}_b")).select(*out)


def stars(edges: DataFrame) -> DataFrame:
    """a, b: every node that has an edge and isn't the smallest of its component, with the smallest. Alternating star
    contractions, checkpointed each round: the number of rounds grows with the logarithm of the longest path, and hubs only
    ever meet their smallest neighbour. Nothing but one checksum a round goes to the driver."""
    now = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    last = None
    while True:
        now = checkpointed(now)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == last or not seen[0]:
            return now
        last = seen
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        now = small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a > b").distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each connected component."""
    found = stars(edges)
    return nodes.select("node").distinct().join(found, F.col("node") == F.col("a"), "left").select("node", F.coalesce("b", "node").alias("root"))


def near_edges(signatures: DataFrame, id_: str, distance: int) -> DataFrame:
    """a, b: near rows that connect whatever all near pairs connect, fewer of each part than it has rows."""
    rows = _told(signatures, [id_])
    how, _ = near.deal(rows, distance)
    found = _joined(rows, [id_], {id_: signatures.schema[id_].dataType.simpleString()}, distance, how, True)
    return found.select(F.col(f"{id_}_a").alias("a"), F.col(f"{id_}_b").alias("b"))


def near_components(signatures: DataFrame, id_: str, distance: int) -> DataFrame:
    """id_, root: the smallest row that near signatures connect each row with. Rows of one signature are one node, and of the
    near pairs only a forest of each part leaves it: neither copies nor crowds make pairs among themselves."""
    nodes = checkpointed(signatures.groupBy("sig_hi", "sig_lo").agg(F.min(id_).alias("__node")))
    found = stars(near_edges(nodes, "__node", distance))
    roots = nodes.join(found, F.col("__node") == F.col("a"), "left").select("sig_hi", "sig_lo", F.coalesce("b", "__node").alias("root"))
    return signatures.join(roots, ["sig_hi", "sig_lo"]).select(id_, "root")
