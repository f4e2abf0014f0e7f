"""N-gram Jaccard join with token-combination prefixes: links, and components of links.

A document is the set of its word shingles (here: tokens, 64-bit hashes). Two documents link when the intersection is at
least `num`/`den` of the union. All tokens have one global order: by the whole binary logarithm of how many sets hold them,
then by hash. A set of n tokens may lack at most e = n - ceil(n*num/den) of them in a set it links with.

Tokens are of two classes. Rare ones are indexed alone. Frequent ones are dealt by hash to `groups(n)` groups, and 2-token
combinations within a group are indexed. A prefix is extended until it covers e + 1: each rare token covers one, a group with
c tokens c - 1, since whoever holds none of its combinations lacks that many. Of two linked sets, the one whose prefix ends
first then has a rare token or a combination that the other one holds too, within its own prefix. So keys grow with the
prefix and not with its square, at any size of a set. Sets of nearly the same size must agree on the number of groups, a power
of two: a set takes part with each number that a smaller partner could have. Sets that may link through a single shared
token (one or two tokens, at any threshold from a half) have all tokens indexed alone, too.

What is frequent comes from the data: of all tokens in the order of their holders, those behind the rarest `rare` part of all
occurrences. Each bucket of the token space decides that for its own tokens, over all documents. Tokens that one set only
holds cover the prefix but find nothing and aren't indexed; where they are half of all occurrences, links come from
combinations alone.

Rounds over blocks (see blocks): 1 blocks tell tokens, buckets answer with those that more sets hold, and their class;
2 blocks give out the sets that have enough shared tokens, with those tokens and classes, and `FIRST` keys of each, of the
commonest tokens. From then on no text is read. The holders of a key make a star: edges to the smallest one, the hub. First
every set is compared with its smallest hub under those few keys, which connects groups of copies. Then all sets tell all
keys, with their components so far, and buckets answer with stars of the keys whose holders aren't all connected: every link
that is still missing lies among the holders of such a hub. Edges whose ends aren't connected are compared; and last, for
each hub, the holders still apart from it with all its holders of other components.

Comparisons are exact and run in tasks of about `spread` sets on either side, so no group of copies is one task. Sets already
connected are never compared again, and their keys make no edges, so groups of thousands of copies cost a few comparisons
for each copy.

Defined cases: null and empty texts and texts without words have an empty set and link with nothing; fewer words than a
shingle are one token, so equal short texts link; rows of one doc_id count as one document with all their links; a null
doc_id gets no component (null) and links nothing; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.blocks import Texts, bounds, components, deal, partitions, regroup, sizes
from skeinwork.llm.common import checkpointed, map_arrow, mix64
from skeinwork.llm.segments import gather, hashes, runs

RARE, SPREAD, FIRST, MOST_BROADCAST, SALT = 0.5, 64, 4, 200_000, 64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TURN = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct tokens of each text, one text after another, and their offsets."""
    n = len(offs) - 1
    low = _LOWER[data]
    s, e, at = runs(~_SPACE[data], offs)
    w = hashes(low, s, e - s)
    counts = np.diff(at)
    with np.errstate(over="ignore"):
        turn = np.concatenate((_TURN, mix64(np.arange(6, width + 6, dtype=np.uint64) * _TURN[0]) | np.uint64(1)))
        full = np.flatnonzero(counts >= width)
        per = counts[full] - width + 1
        first = gather(at[:-1][full], per)
        tokens = [np.zeros(len(first), np.uint64)]
        for k in range(width):
            tokens[0] = tokens[0] + mix64(w[first + k] * turn[k])
        of = [np.repeat(full, per)]
        for size in range(1, width):
            few = np.flatnonzero(counts == size)
            t = np.full(len(few), size, np.uint64) * turn[-1]
            for k in range(size):
                t = t + mix64(w[at[:-1][few] + k] * turn[k])
            tokens.append(t)
            of.append(few)
        token, text = mix64(np.concatenate(tokens)), np.concatenate(of)
    order = np.lexsort((token, text))
    token, text = token[order], text[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (text[1:] != text[:-1])
    return token[new], np.concatenate(([0], np.cumsum(np.bincount(text[new], minlength=n)))) if n else np.zeros(1, np.int64)


class Sets:
    """A block's sets; equal ones are represented by the smallest doc_id."""

    def __init__(self, table: pa.Table, width: int):
        t = Texts(table)
        self.block, self.ids, self.known = t.block, t.ids, t.known
        self.tokens, self.offs = shingle_sets(t.data, t.offs, width)
        self.size = np.diff(self.offs)
        first: dict[bytes, int] = {}
        self.rep = np.arange(len(self.ids))
        for i in np.flatnonzero(self.known & (self.size > 0)).tolist():  # ids ascend, so the first of equal sets has the smallest
            self.rep[i] = first.setdefault(self.tokens[self.offs[i] : self.offs[i + 1]].tobytes(), i)
        self.own = np.flatnonzero((self.rep == np.arange(len(self.ids))) & (self.size > 0) & self.known)


def lacking(n, num: int, den: int):
    """How many of n tokens a linked set may lack."""
    return n - -(-n * num // den)


def _short(tokens: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each token, and 32 more bits; both from its upper bits."""
    return (tokens >> np.uint64(64 - bits)).astype(np.int64), (tokens >> np.uint64(32 - bits)).astype(np.uint32)


def token_messages(sets: Sets, bits: int) -> Iterator[pa.RecordBatch]:
    """Round 1: by bucket, the block's distinct tokens and in how many sets it has them."""
    at = gather(sets.offs[:-1][sets.own], sets.size[sets.own])
    token, count = np.unique(sets.tokens[at], return_counts=True)
    bucket, low = _short(token, bits)
    rows = [(sets.block, b, _counted(low[x:y], count[x:y])) for b, x, y in bounds(bucket)]
    if rows:
        yield _rows(rows)


def _counted(low: np.ndarray, count: np.ndarray) -> bytes:
    """Tokens with their counts: a byte each, and those of 255 or more once again in 4 bytes."""
    large = np.flatnonzero(count >= 255)
    return b"".join((np.uint32(len(low)).tobytes(), low.tobytes(), np.minimum(count, 255).astype(np.uint8).tobytes(), count[large].astype(np.uint32).tobytes()))


def _uncounted(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob, np.uint32, 1)[0])
    low, count = np.frombuffer(blob, np.uint32, n, 4), np.frombuffer(blob, np.uint8, n, 4 + 4 * n).astype(np.int64)
    count[count == 255] = np.frombuffer(blob, np.uint32, -1, 4 + 5 * n)
    return low, count


_MESSAGE = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("payload", pa.binary())])
MESSAGE = "block int, bucket int, payload binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _MESSAGE, strict=True)], schema=_MESSAGE)


def first_frequent(holders: np.ndarray, rare: float) -> int:
    """From how many holders a token is frequent: the tokens below hold at least the part `rare` of all occurrences.

    holders: of each token, 1 or more."""
    size, tokens = np.unique(holders, return_counts=True)
    held = np.cumsum(size * tokens)
    return int(size[np.searchsorted(held, rare * held[-1])]) + 1 if len(size) else 1


def token_answers(rare: float):
    """By block, those of its tokens that more sets hold, and the class: whole binary logarithm of how many, and in the
    highest bit whether that is frequent."""

    def then(table: pa.Table) -> Iterator[pa.RecordBatch]:
        blocks, told = table.column("block").to_pylist(), [_uncounted(x) for x in table.column("payload").to_pylist()]
        n = np.array([len(low) for low, _ in told])
        _, token, total = _summed(np.concatenate([low for low, _ in told]), np.concatenate([count for _, count in told]))
        often = total >= first_frequent(total, rare)
        class_ = (np.floor(np.log2(total)).astype(np.uint8) | often.astype(np.uint8) << np.uint8(7))[token]
        bucket, rows = table.column("bucket")[0].as_py(), []
        for (low, _), block, at, k in zip(told, blocks, np.cumsum(n) - n, n, strict=True):
            held = class_[at : at + k] > 0
            if held.any():
                rows.append((block, bucket, low[held].tobytes() + class_[at : at + k][held].tobytes()))
        if rows:
            yield _rows(rows)

    return then


def _summed(low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, which of them each is, and their sums of counts."""
    known, of = np.unique(low, return_inverse=True)
    return known, of, np.bincount(of, count).astype(np.int64)


def _classes(sets: Sets, answers: pa.Table, bits: int) -> np.ndarray:
    """The class of every token of the block; 0 for tokens that one set only holds."""
    out = np.zeros(len(sets.tokens), np.uint8)
    known, class_ = [], []
    for bucket, blob in zip(answers.column("bucket").to_pylist(), answers.column("payload").to_pylist(), strict=True):
        k = len(blob) // 5
        known.append(np.uint64(bucket) << np.uint64(32) | np.frombuffer(blob, np.uint32, k).astype(np.uint64))
        class_.append(np.frombuffer(blob, np.uint8, k, 4 * k))
    if not known:
        return out
    known, class_ = np.concatenate(known), np.concatenate(class_)
    order = np.argsort(known)
    known, class_ = known[order], class_[order]
    own = sets.tokens >> np.uint64(32 - bits)
    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
    hit = known[at] == own
    out[hit] = class_[at[hit]]
    return out


def groups(n, num: int, den: int):
    """Into how many groups a set of n tokens deals its frequent ones: a quarter of what it may lack, as a power of two."""
    return 1 << np.floor(np.log2(np.maximum(lacking(n, num, den) // 4, 1))).astype(np.int64)


def prefix_keys(tokens: np.ndarray, class_: np.ndarray, held: np.ndarray, size: np.ndarray, num: int, den: int) -> tuple[np.ndarray, ...]:
    """Keys of sets: the key, which set it is of, whether it is a combination, and its tokens' classes in sum.

    tokens, class_: the shared tokens of all sets, set after set, `held` of each set's `size` tokens; whole logarithm of
    holders, 128 more if frequent. The tokens that no other set holds come first in the order and cover one each."""
    least = -(-size * num // den)  # of a partner, or of what is shared with one
    low, high = groups(least, num, den), groups(size, num, den)
    keys, of, kind, weight = [], [], [], []

    def add(key: np.ndarray, owner: np.ndarray, combination: bool, classes: np.ndarray) -> None:
        keys.append(key)
        of.append(owner)
        kind.append(np.full(len(key), combination))
        weight.append(classes)

    owner, common = np.repeat(np.arange(len(size)), held), (class_ & 127).astype(np.int64)
    lonely = (least <= 1)[owner] & (class_ >= 128)
    add(tokens[lonely], owner[lonely], False, common[lonely])
    begin, number = np.cumsum(held) - held, 1
    while len(size) and number <= high.max():
        takes = np.flatnonzero((low <= number) & (number <= high))
        at = gather(begin[takes], held[takes])
        t, c, o, often = tokens[at], common[at], owner[at], class_[at] >= 128
        order = np.lexsort((t, c, o))
        t, c, o, often = t[order], c[order], o[order], often[order]
        group = (mix64(t ^ _TURN[0]) >> np.uint64(20)).astype(np.int64) & (number - 1)
        f = np.flatnonzero(often)
        by = f[np.lexsort((f, group[f], o[f]))]  # by set, group, place in the order
        first = np.ones(len(by), bool)
        first[1:] = (o[by[1:]] != o[by[:-1]]) | (group[by[1:]] != group[by[:-1]])
        covers = np.ones(len(t), np.int64)
        covers[by[first]] = 0
        before = np.concatenate(([0], np.cumsum(covers)))
        ends = np.cumsum(held[takes])
        covered = before[:-1] - np.repeat(before[ends - held[takes]] - (size - held)[takes], held[takes])
        inside = covered <= lacking(size, num, den)[o]
        single = inside & ~often & (number == low[o])
        add(t[single], o[single], False, c[single])
        by, first = by[inside[by]], first[inside[by]]
        start = np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))
        rank = np.arange(len(by)) - start  # pairs of each token with those before it in its group
        right, left = by[np.repeat(np.arange(len(by)), rank)], by[gather(start, rank)]
        with np.errstate(over="ignore"):
            add(mix64(mix64(t[left] * _TURN[1] + np.uint64(number)) + t[right] * _TURN[2]), o[right], True, c[left] + c[right])
        number *= 2
    return tuple(np.concatenate(x) for x in (keys, of, kind, weight))


ROUND2 = "kind string, key long, payload binary"
_ROUND2 = pa.schema([("kind", pa.string()), ("key", pa.int64()), ("payload", pa.binary())])


def _round2(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROUND2, strict=True)], schema=_ROUND2)


def key_messages(sets: Sets, class_: np.ndarray, bits: int, num: int, den: int, kinds: tuple[bool, ...] = (False, True)) -> Iterator[pa.RecordBatch]:
    """Round 2: by bucket, the block's prefix keys with their holders; the sets that may link; documents.

    kinds: which keys to tell, single tokens (False) and combinations (True); for measurements."""
    known = sets.known
    yield _round2([("doc", sets.block, b"".join((sets.ids.tobytes(), sets.size.astype(np.int64).tobytes(), sets.ids[sets.rep].tobytes(), known.astype(np.int64).tobytes())))])
    if not len(sets.own):
        return
    some = np.add.reduceat(class_ > 0, sets.offs[:-1][sets.own])
    use = sets.own[some >= sets.size[sets.own] - lacking(sets.size[sets.own], num, den)]  # enough tokens that others hold
    if not len(use):
        return
    at = gather(sets.offs[:-1][use], sets.size[use])
    owner = np.repeat(np.arange(len(use)), sets.size[use])[class_[at] > 0]
    at = at[class_[at] > 0]
    held = np.bincount(owner, minlength=len(use))
    key, of, kind, weight = prefix_keys(sets.tokens[at], class_[at], held, sets.size[use], num, den)
    some = np.lexsort((key, -weight, of))
    some = some[np.isin(kind[some], kinds)]
    rank = np.arange(len(some)) - np.searchsorted(of[some], of[some])
    some = some[rank < FIRST]
    rows = [("key", b, blob) for b, blob in _told(key[some], bits, sets.ids[use][of[some]])]
    ends = np.cumsum(held)
    for i, a, b in zip(use.tolist(), (ends - held).tolist(), ends.tolist(), strict=True):
        rows.append(("set", int(sets.ids[i]), _packed(int(sets.size[i]), sets.tokens[at[a:b]], class_[at[a:b]])))
    yield _round2(rows)


def _packed(size: int, tokens: np.ndarray, class_: np.ndarray) -> bytes:
    return np.int64(size).tobytes() + tokens.tobytes() + class_.tobytes()


def _unpacked(blob: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    n = (len(blob) - 8) // 9
    return int(np.frombuffer(blob, np.int64, 1)[0]), np.frombuffer(blob, np.uint64, n, 8), np.frombuffer(blob, np.uint8, n, 8 + 8 * n)


def _told(key: np.ndarray, bits: int, *values: np.ndarray) -> list[tuple[int, bytes]]:
    """By bucket, keys and what goes with them (64 bits each), packed."""
    order = np.argsort(key)
    key, values = key[order], [v[order].astype(np.int64) for v in values]
    return [(b, b"".join((key[x:y].tobytes(), *(v[x:y].tobytes() for v in values)))) for b, x, y in bounds((key >> np.uint64(64 - bits)).astype(np.int64))]


def all_keys(bits: int, num: int, den: int, kinds: tuple[bool, ...]):
    """By bucket, all keys of sets with holders and components. Rows: doc_id, component, payload."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            size, tokens, class_ = zip(*map(_unpacked, b.column("payload").to_pylist()), strict=True)
            held = np.array([len(t) for t in tokens])
            key, of, kind, _ = prefix_keys(np.concatenate(tokens), np.concatenate(class_), held, np.array(size), num, den)
            told, ids, comp = np.isin(kind, kinds), b.column("doc_id").to_numpy(), b.column("component").to_numpy()
            rows = _told(key[told], bits, ids[of[told]], comp[of[told]])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], names=["key", "payload"])

    return walk


def _columns(table: pa.Table, n: int) -> list[np.ndarray]:
    """The packed columns of a bucket (keys, then n - 1 more), in the order of keys and holders."""
    blobs = table.column("payload").to_pylist()
    parts = [np.frombuffer(x, np.int64).reshape(n, -1) for x in blobs]
    found = np.concatenate(parts, axis=1)
    return list(found[:, np.lexsort((found[1], found[0]))])


def least_hubs(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """From a bucket of the first keys: each holder's smallest hub."""
    key, holder = _columns(table, 2)
    hub = holder[np.searchsorted(key, key)]
    order = np.lexsort((hub, holder))
    a, b = holder[order], hub[order]
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    new &= a != b
    yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], names=["a", "b"])


def open_stars(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """From a bucket of all keys: stars of those whose holders are of several components. a, b (the hub), ca, cb."""
    key, holder, comp = _columns(table, 3)
    first = np.searchsorted(key, key)
    runs_ = np.flatnonzero(np.diff(key, prepend=key[0] - 1)) if len(key) else key
    mixed = np.minimum.reduceat(comp, runs_) != np.maximum.reduceat(comp, runs_)
    keep = np.repeat(mixed, np.diff(runs_, append=len(key))) & (holder != holder[first])
    edges = np.unique(np.stack((holder[keep], holder[first][keep], comp[keep], comp[first][keep]), 1), axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in edges.T], names=["a", "b", "ca", "cb"])


def unpacked_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for blob in b.column("payload").to_pylist():
            d = np.frombuffer(blob, np.int64).reshape(4, -1)
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in d[:3]), pa.array(d[3] > 0)], names=["doc_id", "n_shingles", "rep", "known"])


def links_between(left: list[tuple], right: list[tuple], num: int, den: int) -> list[tuple[int, int]]:
    """Which sets of the left link with sets of the right that are in another component; one link for each component
    that the right side brings is enough. left, right: doc_id, component, size, sorted shared tokens."""
    ids, comp = np.array([r[0] for r in right]), np.array([r[1] for r in right])
    size, own = np.array([r[2] for r in right]), np.array([len(r[3]) for r in right])
    tokens = np.concatenate([r[3] for r in right])
    offs, out = np.cumsum(own) - own, []
    for doc_id, part, n, mine in left:
        most = np.minimum(len(mine), own)
        open_ = np.flatnonzero((comp != part) & (ids != doc_id) & (most * (num + den) >= num * (n + size)))
        if not len(open_):
            continue
        at = gather(offs[open_], own[open_])
        place = np.minimum(np.searchsorted(mine, tokens[at]), len(mine) - 1)
        both = np.add.reduceat((mine[place] == tokens[at]).astype(np.int64), np.cumsum(own[open_]) - own[open_])
        linked = open_[den * both >= num * (n + size[open_] - both)]
        out += [(doc_id, int(ids[k])) for k in linked[np.unique(comp[linked], return_index=True)[1]]]
    return out


def joined(num: int, den: int):
    """Verifies the sets of a task; rows: task, side (0 or 1), doc_id, component, payload."""

    def then(table: pa.Table) -> Iterator[pa.RecordBatch]:
        sides: tuple[list, list] = ([], [])
        for side, doc_id, comp, blob in zip(*(table.column(c).to_pylist() for c in ("side", "doc_id", "component", "payload")), strict=True):
            sides[side].append((doc_id, comp, *_unpacked(blob)[:2]))
        found = links_between(*sides, num, den) if all(sides) else []
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return then


def _compared(left: DataFrame, right: DataFrame, sets: DataFrame, n: int, num: int, den: int, spread: int) -> DataFrame:
    """Links a, b between the sets of each hub's left and right side. left, right: hub, doc_id, component.

    Both sides are cut by hash into parts of about `spread` sets, and each part of the one meets each of the other in a task.
    Only hubs that need cutting are looked up, by a broadcast while they are few (`MOST_BROADCAST`, by count)."""
    parts = lambda d, name: d.groupBy("hub").agg(F.ceil(F.count("*") / F.lit(spread)).alias(name))
    large = checkpointed(parts(left, "i").join(parts(right, "j"), "hub").where("i > 1 or j > 1"))
    cut = F.broadcast(large) if large.count() <= MOST_BROADCAST else large
    place = lambda c: F.pmod(F.xxhash64("doc_id"), F.coalesce(c, F.lit(1)))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(c, F.lit(1)) - 1))
    task = F.concat_ws(":", "hub", "x", "y").alias("task")
    one = left.join(cut, "hub", "left").withColumn("x", place("i")).withColumn("y", every("j")).select(task, F.lit(0).alias("side"), "doc_id", "component")
    two = right.join(cut, "hub", "left").withColumn("y", place("j")).withColumn("x", every("i")).select(task, F.lit(1).alias("side"), "doc_id", "component")
    return regroup(one.unionByName(two).join(sets, "doc_id"), "task", n, joined(num, den), "a long, b long")


def _labelled(nodes: DataFrame, node: str, found: DataFrame, component: str) -> DataFrame:
    """`nodes` with the component of a node, which is itself where it has no link. found: node, component."""
    part = found.select(F.col("node").alias(node), F.col("component").alias(component))
    part = F.broadcast(part) if part.count() <= MOST_BROADCAST else part  # 16 bytes a row
    return nodes.join(part, node, "left").withColumn(component, F.coalesce(component, node))


def _of_hubs(rows: DataFrame, hubs: DataFrame) -> DataFrame:
    """`rows` whose hub b is one of `hubs`. A hub may have a third of all rows, so where they are too many for a broadcast
    (`MOST_BROADCAST`, by count) the rows of a hub are dealt to `SALT` tasks."""
    if hubs.count() <= MOST_BROADCAST:
        return rows.join(F.broadcast(hubs), "b", "left_semi")
    salted = hubs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALT)).cast("int")).join(salted, ["b", "salt"], "left_semi").drop("salt")


def near_duplicates(documents: DataFrame, width: int = 5, num: int = 8, den: int = 10, rare: float = RARE, spread: int = SPREAD, kinds: tuple[bool, ...] = (False, True)) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links of Jaccard at least num/den (a half or more) reach."""
    if not den <= 2 * num <= 2 * den:
        raise ValueError("num/den must be from a half to one")
    n_blocks = sizes(documents)
    n, bits = partitions(n_blocks), max(1, int(np.ceil(np.log2(max(2, partitions(n_blocks))))))
    texts = deal(documents, n_blocks)

    def tell(table: pa.Table) -> pa.Table:
        return _table(token_messages(Sets(table, width), bits), _MESSAGE)

    def tell_keys(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return _table(iter(()), _ROUND2)
        sets = Sets(table, width)
        return _table(key_messages(sets, _classes(sets, answers, bits), bits, num, den, kinds), _ROUND2)

    told = texts.groupBy("block").applyInArrow(tell, MESSAGE)
    answers = regroup(told, "bucket", n, token_answers(rare), MESSAGE).repartition(n, "block")
    second = checkpointed(texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(tell_keys, ROUND2))
    docs = map_arrow(second.where("kind = 'doc'"), unpacked_docs, "doc_id long, n_shingles long, rep long, known boolean")
    sets = second.where("kind = 'set'").select(F.col("key").alias("doc_id"), "payload")
    told = regroup(second.where("kind = 'key'").drop("kind"), "key", n, least_hubs, "a long, b long")
    least = checkpointed(told.groupBy("a").agg(F.min("b").alias("b")))

    hub = F.col("b").alias("hub")
    one = lambda d, end, c: d.select(hub, F.col(end).alias("doc_id"), F.col(c).alias("component")).distinct()
    # rows of one doc_id with several sets are one document
    same = docs.where("known").groupBy("doc_id").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x <> y")
    same = docs.where("known").join(same, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    def connected(found: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
        """Components of what was found so far and of the links between the sides."""
        return components(found.unionByName(_compared(left, right, sets, n, num, den, spread)))

    edges = lambda found: found.select(F.col("node").alias("a"), F.col("component").alias("b"))
    found = connected(same, one(least, "b", "b"), one(least, "a", "a"))
    told = map_arrow(_labelled(sets, "doc_id", found, "component"), all_keys(bits, num, den, kinds), "key long, payload binary")
    stars = checkpointed(regroup(told, "key", n, open_stars, "a long, b long, ca long, cb long").distinct())
    untried = stars.where("ca <> cb").join(least, ["a", "b"], "left_anti")
    found = connected(edges(found), one(untried, "b", "cb"), one(untried, "a", "ca"))
    around = checkpointed(_labelled(_labelled(stars.select("a", "b"), "a", found, "ca"), "b", found, "cb"))
    # the holders that are still apart from their hub, with all holders of that hub
    apart = around.where("ca <> cb")
    around = _of_hubs(around, checkpointed(apart.select("b").distinct()))
    labels = connected(edges(found), one(apart, "a", "ca"), one(around, "a", "ca"))
    final = docs.join(labels, docs["rep"] == labels["node"], "left")
    return final.select(F.when(F.col("known"), F.col("doc_id")).alias("doc_id"), "n_shingles", F.when(F.col("known"), F.coalesce("component", "rep")).alias("component_id"))


def _table(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches(list(batches), schema)


def digest(documents: DataFrame) -> DataFrame:
    return near_duplicates(documents, 3, 9, 10)


def one_of_each(documents: DataFrame, **how) -> DataFrame:
    """The rows of `documents` whose doc_id is the smallest of its component; rows without a doc_id stay."""
    first = near_duplicates(documents, **how).where("doc_id = component_id").select("doc_id").distinct()
    return documents.join(first, "doc_id", "left_semi").select(*documents.columns).unionByName(documents.where("doc_id is null"))
