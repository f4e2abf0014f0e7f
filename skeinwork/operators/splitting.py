"""Leakage-safe splits: whole capture groups are assigned so that images and classes near their targets.

Groups of the same vector (images, objects of each class) weigh the same wherever they go, so the search is over distinct
vectors with counts: how many groups of each vector a split gets. The driver holds the distinct vectors and nothing else of
the groups. Which groups those are is decided where they lie: in key order those of a vector fill train, then val, then test.

The rule, as one group after another would have it: largest groups first (images, then objects, then vector, then key), each
to the split where it adds least to the error, the first of SPLITS among equals; then, by vector and by the split they are in,
each to where a move gains most while that is more than LEAST_GAIN, for ROUNDS rounds at most. A run of equal groups is dealt
at once: what each further one adds to a split grows by the same step, so the splits' costs are three arithmetic progressions
and a run takes its smallest terms. All costs are whole numbers, so that a run comes out as its groups one by one do.

Up to EXHAUSTIVE groups the best of all allocations that use every split is taken instead, the first in key order and the
order of SPLITS among equals.
"""

from __future__ import annotations

from fractions import Fraction
from math import floor, lcm, prod

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.schema import CLASSES, SPLITS
from skeinwork.session import checkpointed

# Fixed values of the rule. A split's error is the sum over images and classes of the squared distance to the target, in units
# of the target (of one, if that is less), by the weights of images and classes.
RATIOS = {"train": 0.70, "val": 0.15, "test": 0.15}
EXHAUSTIVE, ROUNDS, CHUNK = 12, 20, 1 << 16
LOOK = 64  # vectors that are looked at together behind a move
LEAST_GAIN = Fraction(1, 10**12)

PARTS = ("images", *(f"c{c}" for c in CLASSES))
Vector = tuple[int, ...]


def group_vectors(rows: DataFrame) -> DataFrame:
    """group_key, images, c0, c1, c2. rows: group_key, class_id (of one object), image."""
    return rows.groupBy("group_key").agg(F.countDistinct("image").alias("images"), *(F.count_if(F.col("class_id") == c).alias(f"c{c}") for c in CLASSES))


def _exact(x: float) -> Fraction:
    return Fraction(str(x))


class Costs:
    """What a group's vector adds to a split's error, in whole numbers of a common unit."""

    def __init__(self, total: Vector, ratios: dict[str, float], image_weight: float, class_weight: float):
        if set(ratios) != set(SPLITS) or abs(sum(ratios.values()) - 1) > 1e-6:
            raise ValueError("ratios must be given for train, val and test and sum to 1")
        weight = [_exact(image_weight)] + [_exact(class_weight)] * len(CLASSES)
        target = [[_exact(ratios[s]) * n for n in total] for s in SPLITS]
        unit = lcm(*(t.denominator for row in target for t in row))
        per = [[w / max(t, Fraction(1)) ** 2 for w, t in zip(weight, row, strict=True)] for row in target]
        whole = lcm(*(p.denominator for row in per for p in row))
        self.unit, self.least = unit, floor(LEAST_GAIN * whole * unit)  # of whole numbers, those below -floor(x) are those below -x
        self.scale = float(whole * unit)
        self.target = [[int(t * unit) for t in row] for row in target]
        self.per = [[int(p * whole) for p in row] for row in per]

    def put(self, split: int, held: list[int], v: Vector) -> int:
        """What one more group of v adds to the split's error, which holds `held`."""
        return sum(p * x * (2 * (h * self.unit - t) + x * self.unit) for p, t, h, x in zip(self.per[split], self.target[split], held, v, strict=True))

    def step(self, split: int, v: Vector) -> int:
        """By how much that grows with each group of v that the split gets."""
        return 2 * self.unit * sum(p * x * x for p, x in zip(self.per[split], v, strict=True))

    def may_gain(self, held: list[list[int]], vectors: np.ndarray, there: np.ndarray) -> np.ndarray:
        """Vectors of which some group might gain by a move, with room for rounding; there: whether a split has any of the vector."""
        put, take = (
            np.stack([sum(float(p) * self.unit * x * (2 * sign * (h - t / self.unit) + x) / self.scale for p, t, h, x in zip(self.per[s], self.target[s], held[s], vectors.T, strict=True)) for s in range(len(SPLITS))], 1)
            for sign in (1, -1)
        )
        cost = put[:, None, :] + take[:, :, None]
        cost[:, range(len(SPLITS)), range(len(SPLITS))] = np.inf
        return ((cost.min(-1) < 1e-9) & there).any(1)

    def error(self, split: int, held: np.ndarray) -> np.ndarray:
        """Errors of many holdings (the last axis has the parts), for the exhaustive search, in the same unit."""
        return sum(p * (held[..., k].astype(object) * self.unit - t) ** 2 for k, (p, t) in enumerate(zip(self.per[split], self.target[split], strict=True)))


def smallest(n: int, first: list[int], step: list[int]) -> list[int]:
    """How many terms of each progression are among the n smallest of all; equal terms go to the earlier progression.

    All terms up to the level at which the progressions, were they lines, make up n less one for each are among them; the few
    others are taken one by one."""
    m = len(first)
    if not any(step):
        k = first.index(min(first))
        return [n if i == k else 0 for i in range(m)]
    taken = [0] * m
    if n > m:
        order = sorted(range(m), key=first.__getitem__)
        for k in range(1, m + 1):
            active = order[:k]
            all_ = prod(step[i] for i in active)
            level = ((n - m) * all_ + sum(all_ // step[i] * first[i] for i in active)) // sum(all_ // step[i] for i in active)
            if k == m or level < first[order[k]]:
                break
        taken = [(level - first[i]) // step[i] + 1 if level >= first[i] else 0 for i in range(m)]
    following = [a + t * b for a, t, b in zip(first, taken, step, strict=True)]
    for _ in range(n - sum(taken)):
        k = following.index(min(following))
        taken[k] += 1
        following[k] += step[k]
    return taken


def _largest_first(vectors: list[Vector]) -> list[Vector]:
    return sorted(vectors, key=lambda v: (-v[0], -sum(v[1:]), v))


def dealt(counts: dict[Vector, int], ratios: dict[str, float] = RATIOS, image_weight: float = 1.0, class_weight: float = 1.0) -> dict[Vector, list[int]]:
    """By vector, how many of its groups each split gets."""
    total = tuple(sum(n * v[k] for v, n in counts.items()) for k in range(len(PARTS)))
    cost = Costs(total, ratios, image_weight, class_weight)
    held = [[0] * len(PARTS) for _ in SPLITS]
    order = _largest_first(list(counts))
    places: dict[Vector, list[int]] = {}

    def add(split: int, v: Vector, n: int) -> None:
        held[split] = [h + n * x for h, x in zip(held[split], v, strict=True)]

    for v in order:
        places[v] = smallest(counts[v], [cost.put(s, held[s], v) for s in range(len(SPLITS))], [cost.step(s, v) for s in range(len(SPLITS))])
        for s, n in enumerate(places[v]):
            add(s, v, n)
    def move(v: Vector) -> bool:
        """Moves as many groups of v as gain, from each split it was in to the others; did any?"""
        moved, steps = False, [cost.step(s, v) for s in range(len(SPLITS))]
        for source, there in enumerate(list(places[v])):
            others = [s for s in range(len(SPLITS)) if s != source]
            first, other_steps = [cost.put(s, held[s], v) for s in others], [steps[s] for s in others]
            # the error that taking one away saves is what putting it back would add, and falls with each that goes
            back = cost.put(source, [h - x for h, x in zip(held[source], v, strict=True)], v)
            low, high, n = 0, there, 1
            while low < high:  # the last of n moves costs no less and saves less than the one before it
                taken = smallest(n, first, other_steps)
                last = max(a + (t - 1) * b for a, t, b in zip(first, taken, other_steps, strict=True) if t)
                if last - (back - (n - 1) * steps[source]) < -cost.least:
                    low, n = n, min(2 * n, (n + high + 1) // 2)
                else:
                    high, n = n - 1, (low + n) // 2
            if low:
                for s, n in zip(others, smallest(low, first, other_steps), strict=True):
                    add(s, v, n)
                    places[v][s] += n
                add(source, v, -low)
                places[v][source] -= low
                moved = True
        return moved

    vectors = np.array(order, float).reshape(-1, len(PARTS))
    there = np.array([places[v] for v in order]) > 0
    for _ in range(ROUNDS):
        at, ahead, moved = 0, LOOK, False
        while at < len(order):
            # which of the next vectors might gain, all at once in floating point; whether they do is decided exactly
            end = min(at + ahead, len(order))
            for k in np.flatnonzero(cost.may_gain(held, vectors[at:end], there[at:end])).tolist():
                if move(order[at + k]):
                    there[at + k] = np.array(places[order[at + k]]) > 0
                    at, ahead, moved = at + k + 1, LOOK, True
                    break
            else:
                at, ahead = end, 2 * ahead
        if not moved:
            break
    if not all(any(p[s] for p in places.values()) for s in range(len(SPLITS))):
        raise ValueError("groups are too few for three splits")
    return places


def best_of_all(vectors: list[Vector], ratios: dict[str, float] = RATIOS, image_weight: float = 1.0, class_weight: float = 1.0) -> list[int]:
    """The best allocation of a few groups. An allocation is a number whose digits, the first group's highest, are splits."""
    n, m = len(vectors), len(SPLITS)
    own = np.array(vectors, np.int64).reshape(n, len(PARTS))
    cost = Costs(tuple(own.sum(0).tolist()), ratios, image_weight, class_weight)
    best, chosen = None, None
    for low in range(0, m**n, CHUNK):
        number = np.arange(low, min(low + CHUNK, m**n))
        member = (number[:, None] // m ** np.arange(n - 1, -1, -1) % m)[:, :, None] == np.arange(m)
        number, member = number[member.any(1).all(-1)], member[member.any(1).all(-1)]
        if len(number):
            held = np.einsum("agm,gc->amc", member.astype(np.int64), own)
            score = sum(cost.error(s, held[:, s]) for s in range(m))
            k = int(score.argmin())
            if best is None or score[k] < best:
                best, chosen = score[k], member[k].argmax(1).tolist()
    if chosen is None:
        raise ValueError("groups are too few for three splits")
    return chosen


def assignment(groups: dict[str, list[int]], **how) -> dict[str, str]:
    """The split of each of the groups at hand: key -> [images, objects of each class]. how: ratios, image_weight, class_weight."""
    keys = sorted(groups)
    if len(keys) <= EXHAUSTIVE:
        return {k: SPLITS[s] for k, s in zip(keys, best_of_all([tuple(groups[k]) for k in keys], **how), strict=True)}
    of: dict[Vector, list[str]] = {}
    for k in keys:
        of.setdefault(tuple(groups[k]), []).append(k)
    places = dealt({v: len(own) for v, own in of.items()}, **how)
    return {k: SPLITS[s] for v, own in of.items() for k, s in zip(own, [s for s, n in enumerate(places[v]) for _ in range(n)], strict=True)}


def assign(vectors: DataFrame, **how) -> DataFrame:
    """group_key, split; as assignment(). A group's rank among those of its vector is what lies before it in partitions sorted
    by vector and key: counts of partitions are summed, groups are never brought together by vector."""
    spark = vectors.sparkSession
    sorted_ = vectors.select("group_key", *PARTS).orderBy(*PARTS, "group_key").withColumn("at", F.monotonically_increasing_id())  # partition << 33 | row
    keyed = checkpointed(sorted_.withColumn("part", F.shiftright("at", 33)))
    pieces = keyed.groupBy(*PARTS, "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    counts = {tuple(r[p] for p in PARTS): r["n"] for r in pieces.groupBy(*PARTS).agg(F.sum("n").alias("n")).collect()}
    if not counts:
        return keyed.select("group_key", F.lit("").alias("split"))
    if sum(counts.values()) <= EXHAUSTIVE:
        own = {r["group_key"]: [r[p] for p in PARTS] for r in keyed.collect()}
        return spark.createDataFrame(list(assignment(own, **how).items()), "group_key string, split string")
    cuts = spark.createDataFrame([(*v, p[0], p[0] + p[1]) for v, p in dealt(counts, **how).items()], ", ".join(f"{p} long" for p in (*PARTS, "train", "val")))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*PARTS).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = pieces.withColumn("before", before).join(cuts, list(PARTS))
    rank = F.col("before") + F.col("at") - F.col("first")
    split = F.when(rank < F.col("train"), SPLITS[0]).when(rank < F.col("val"), SPLITS[1]).otherwise(SPLITS[2])
    return keyed.join(starts, [*PARTS, "part"]).select("group_key", split.alias("split"))
