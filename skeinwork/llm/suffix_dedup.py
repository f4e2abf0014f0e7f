"""Removal of passages that an earlier document has, by sorted suffixes.

A byte goes if it lies in a string of `length` bytes that also starts in a document with a smaller doc_id. To know that, all
places where such a string starts must meet. They do by their minimizer: the least hash of the 16-byte strings inside it.
Places in a row that share a minimizer make one segment (its places and the length-1 bytes behind them). In three rounds
over blocks (see blocks):

1. Blocks tell which minimizers they hold, and whether in two documents. Buckets answer with those that two documents
   anywhere hold; all other segments cannot repeat and are never sorted.
2. A block sorts the suffixes at all places of the segments of those minimizers in two stages (see suffix_sort) and computes
   adjacent common prefixes; places whose prefixes agree for `length` bytes are one string. The first place of each string
   speaks for it, and the segments around such places are sent, so what many documents of a block share is sent once. A
   bucket sorts what all blocks sent in the same way and answers with a bit for each place: whether a document before the
   sender's has the string.
3. A place goes if the first place of its string in the block is an earlier document's, or if that one's bit is set. Blocks
   sort once more for that. Covered bytes and runs follow.

Every removal so comes from two neighbours in a suffix order. `length` may be anything from 16 bytes on.

Defined cases: null counts as an empty text; texts shorter than `length` lose nothing; matches inside one document or among
rows of one doc_id remove nothing; rows with a null doc_id come after all others and lose to them only; very long texts are
walked in pieces; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.blocks import Texts, bounds, deal, partitions, regroup, sizes
from skeinwork.llm.common import mix64, slices
from skeinwork.llm.segments import gather
from skeinwork.llm.suffix_sort import common_prefixes, suffix_array

LENGTH, GRAM, MOST_PLACES, PIECE, NOBODY = 50, 16, 64, 1 << 20, 128
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
MESSAGE = "block int, bucket int, payload binary"
_MESSAGE = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("payload", pa.binary())])


class Segments:
    """A block's segments, in the order of documents and places."""

    def __init__(self, texts: Texts, length: int = LENGTH):
        self.texts, self.length = texts, length
        starts, counts, least, of = [], [], [], []
        for i, j, data, offs in slices(texts.data, texts.offs, PIECE):
            for a in range(0, max(1, len(data)), PIECE) if len(data) > 2 * PIECE else (0,):  # one very long text, in pieces of places
                b = min(len(data), a + PIECE + length - 1) if len(data) > 2 * PIECE else len(data)
                s, n, h = _runs(data[a:b], offs if b - a == len(data) else np.array([0, b - a]), length)
                s = s + a
                starts.append(s + texts.offs[i])
                counts.append(n)
                least.append(h)
                of.append(np.searchsorted(offs, s, "right") - 1 + i)
        join = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
        self.start, self.count, self.hash, self.of = join(starts, np.int64), join(counts, np.int64), join(least, np.uint64), join(of, np.int64)


def _runs(data: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, numbers of places and minimizers of the segments of a slice of texts."""
    n = len(data) - length + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    m = len(data) - GRAM + 1
    with np.errstate(over="ignore"):
        word = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
        h = mix64(word[:m] * _A ^ (word[8 : 8 + m] * _B + _A))
    wide, window = 1, length - GRAM + 1
    while 2 * wide <= window:
        h = np.minimum(h[:-wide], h[wide:])
        wide *= 2
    if wide < window:
        h = np.minimum(h[: len(h) - (window - wide)], h[window - wide :])
    # places whose string ends inside their text
    valid = np.zeros(n + 1, np.int8)
    size = np.diff(offs)
    some = size >= length
    np.add.at(valid, offs[:-1][some], 1)
    np.add.at(valid, offs[1:][some] - length + 1, -1)
    valid = np.cumsum(valid[:n]).astype(bool)
    new = valid.copy()
    new[1:] &= (h[1:] != h[:-1]) | ~valid[:-1]
    new[offs[:-1][some]] = True
    start = np.flatnonzero(new)
    last = valid.copy()
    last[:-1] &= new[1:] | ~valid[1:]
    count = np.flatnonzero(last) + 1 - start
    if len(count) and count.max() > MOST_PLACES:  # long runs (of one byte, say) in pieces
        pieces = -(-count // MOST_PLACES)
        part = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin, whole = np.repeat(start, pieces) + part * MOST_PLACES, np.repeat(count, pieces)
        start, count = begin, np.minimum(MOST_PLACES, whole - part * MOST_PLACES)
    return start, count, h[start]


def _parts(hash_: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 32 more bits. Minimizers are small, so they are mixed once more."""
    h = mix64(hash_ ^ _B)
    return (h >> np.uint64(64 - bits)).astype(np.int64), (h >> np.uint64(32 - bits)).astype(np.uint32)


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 3, _MESSAGE, strict=True)], schema=_MESSAGE)


def _batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield from _table(rows).to_batches()


def minimizer_messages(seg: Segments, bits: int) -> pa.Table:
    """Round 1: by bucket, distinct minimizers and whether two documents of the block have them."""
    bucket, low = _parts(seg.hash, bits)
    full = bucket.astype(np.uint64) << np.uint64(32) | low.astype(np.uint64)
    order = np.lexsort((seg.of, full))
    full, of = full[order], seg.of[order]
    new = np.ones(len(full), bool)
    new[1:] = full[1:] != full[:-1]
    at = np.flatnonzero(new)
    two = np.zeros(len(at), np.uint8)
    if len(at):
        last = np.append(at[1:], len(full)) - 1
        two = (of[at] != of[last]).astype(np.uint8)
    full = full[at]
    low, rows = (full & np.uint64(0xFFFFFFFF)).astype(np.uint32), []
    for b, x, y in bounds((full >> np.uint64(32)).astype(np.int64)):
        rows.append((seg.texts.block, b, low[x:y].tobytes() + two[x:y].tobytes()))
    return _table(rows)


def minimizer_answers(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """By block, its minimizers that two documents anywhere have."""
    blocks, blobs = table.column("block").to_pylist(), table.column("payload").to_pylist()
    n = np.array([len(x) // 5 for x in blobs])
    low = np.concatenate([np.frombuffer(x, np.uint32, k) for x, k in zip(blobs, n, strict=True)])
    two = np.concatenate([np.frombuffer(x, np.uint8, k, 4 * k) for x, k in zip(blobs, n, strict=True)])
    _, group, holders = np.unique(low, return_inverse=True, return_counts=True)
    held = (holders + np.bincount(group, two))[group] > 1
    bucket, rows = table.column("bucket")[0].as_py(), []
    for block, at, k in zip(blocks, np.cumsum(n) - n, n, strict=True):
        own = low[at : at + k][held[at : at + k]]
        if len(own):
            rows.append((block, bucket, own.tobytes()))
    yield from _batches(rows)


def _width(length: int) -> int:
    return -(-length // 8) * 8


class Ranked:
    """The strings of a block's held segments in suffix order, and the segments it sends."""

    def __init__(self, seg: Segments, answers: pa.Table, bits: int):
        bucket, low = _parts(seg.hash, bits)
        wanted = [np.uint64(b) << np.uint64(32) | np.frombuffer(x, np.uint32).astype(np.uint64) for b, x in zip(answers.column("bucket").to_pylist(), answers.column("payload").to_pylist(), strict=True)]
        full = bucket.astype(np.uint64) << np.uint64(32) | low.astype(np.uint64)
        at = np.flatnonzero(np.isin(full, np.concatenate(wanted))) if wanted else np.empty(0, np.int64)
        text, self.length = seg.texts.data, seg.length
        place = gather(seg.start[at], seg.count[at])
        segment = np.repeat(np.arange(len(at)), seg.count[at])
        marked = np.zeros(len(text), bool)
        marked[place] = True
        self.order = suffix_array(text, marked, _width(seg.length))
        head = common_prefixes(self.order, text, seg.length) < seg.length
        # documents ascend, so the first place of a string is in the earliest document that has it
        self.first = np.minimum.reduceat(self.order, np.flatnonzero(head)) if len(self.order) else self.order
        self.string = np.cumsum(head) - 1
        speaks = np.zeros(len(text), bool)
        speaks[self.first] = True
        own = np.flatnonzero(speaks[place])
        # each sent segment from its first place that speaks to its last
        which, begin = np.unique(segment[own], return_index=True)
        end = np.append(begin[1:], len(own)) - 1 if len(own) else begin
        self.start, self.count = place[own[begin]], place[own[end]] - place[own[begin]] + 1
        self.of, self.bucket = seg.of[at[which]], bucket[at[which]]
        self.by = np.argsort(self.bucket, kind="stable")

    def messages(self, texts: Texts) -> pa.Table:
        rows, body, size = [], texts.data, self.length - 1
        for b, x, y in bounds(self.bucket[self.by]):
            own = self.by[x:y]
            count = (self.count[own] | np.where(texts.known[self.of[own]], 0, NOBODY)).astype(np.uint8)
            strings = body[gather(self.start[own], self.count[own] + size)]
            rows.append((texts.block, b, b"".join((np.int64(len(own)).tobytes(), texts.ids[self.of[own]].tobytes(), count.tobytes(), strings.tobytes()))))
        return _table(rows)


def sorted_answers(length: int):
    """Round 2 in a bucket: a bit mask for each segment of each block, in the order it was sent."""

    def then(table: pa.Table) -> Iterator[pa.RecordBatch]:
        blocks, blobs, bucket = table.column("block").to_pylist(), table.column("payload").to_pylist(), table.column("bucket")[0].as_py()
        n = np.array([int(np.frombuffer(x, np.int64, 1)[0]) for x in blobs])
        holder = np.concatenate([np.frombuffer(x, np.int64, k, 8) for x, k in zip(blobs, n, strict=True)])
        count = np.concatenate([np.frombuffer(x, np.uint8, k, 8 + 8 * k) for x, k in zip(blobs, n, strict=True)])
        nobody, count = count & NOBODY, (count & (NOBODY - 1)).astype(np.int64)
        by = np.lexsort((holder, nobody))
        new = np.ones(len(by), bool)
        new[1:] = (holder[by[1:]] != holder[by[:-1]]) | (nobody[by[1:]] != nobody[by[:-1]])
        rank = np.empty(len(by), np.int64)
        rank[by] = np.cumsum(new)
        size = count + length - 1
        # one text of all segments, a zero byte behind each
        begin = np.cumsum(size + 1) - (size + 1)
        text = np.zeros(int((size + 1).sum()), np.uint8)
        text[gather(begin, size)] = np.concatenate([np.frombuffer(x, np.uint8, -1, 8 + 9 * k) for x, k in zip(blobs, n.tolist(), strict=True)])
        place = gather(begin, count)
        marked, of = np.zeros(len(text), bool), np.zeros(len(text), np.int32)
        marked[place] = True
        of[place] = np.repeat(np.arange(len(count)), count)
        order = suffix_array(text, marked, _width(length))
        head = common_prefixes(order, text, length) < length
        owner = rank[of[order]]
        least = np.minimum.reduceat(owner, np.flatnonzero(head)) if len(order) else owner
        earlier = order[least[np.cumsum(head) - 1] < owner]
        mask = np.zeros(len(count), np.uint64)
        np.bitwise_or.at(mask, of[earlier], np.uint64(1) << (earlier - begin[of[earlier]]).astype(np.uint64))
        rows = [(block, bucket, mask[at : at + k].tobytes()) for block, at, k in zip(blocks, np.cumsum(n) - n, n, strict=True) if mask[at : at + k].any()]
        yield from _batches(rows)

    return then


def removed(texts: Texts, sent: Ranked, answers: pa.Table) -> np.ndarray:
    """Which bytes of the block go."""
    mask = np.zeros(len(sent.start), np.uint64)
    by = {b: (x, y) for b, x, y in bounds(sent.bucket[sent.by])}
    for b, blob in zip(answers.column("bucket").to_pylist(), answers.column("payload").to_pylist(), strict=True):
        x, y = by[b]
        mask[sent.by[x:y]] = np.frombuffer(blob, np.uint64)
    inside = gather(np.zeros(len(sent.count), np.int64), sent.count)
    elsewhere = np.zeros(len(texts.data), bool)
    elsewhere[gather(sent.start, sent.count)] = (np.repeat(mask, sent.count) >> inside.astype(np.uint64) & np.uint64(1)).astype(bool)
    new = np.ones(len(texts.ids), bool)
    new[1:] = (texts.ids[1:] != texts.ids[:-1]) | (texts.known[1:] != texts.known[:-1])
    document = np.repeat(np.cumsum(new), np.diff(texts.offs))  # rows of one doc_id are one
    first = sent.first[sent.string]
    goes = sent.order[(document[first] < document[sent.order]) | elsewhere[first]]
    edge = np.zeros(len(texts.data) + 1, np.int32)
    np.add.at(edge, goes, 1)
    np.add.at(edge, goes + sent.length, -1)
    return np.cumsum(edge[:-1]) > 0


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def results(seg: Segments, gone: np.ndarray, text: bool) -> pa.Table:
    t, rows = seg.texts, []
    for i, (a, b) in enumerate(zip(t.offs[:-1].tolist(), t.offs[1:].tolist(), strict=True)):
        g = gone[a:b]
        kept = t.data[a:b][~g].tobytes()
        spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
        doc_id = int(t.ids[i]) if t.known[i] else None
        rows.append((doc_id, b - a, int(g.sum()), spans, hashlib.sha256(kept).hexdigest()) + ((kept,) if text else ()))
    schema = _RESULT.append(pa.field("kept", pa.binary())) if text else _RESULT
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def remove_repeats(documents: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and (with_text) the remaining bytes as `kept`."""
    if length < GRAM:
        raise ValueError(f"length must be {GRAM} bytes or more")
    n_blocks = sizes(documents)
    n = partitions(n_blocks)
    bits = max(1, int(np.ceil(np.log2(2 * n))))
    texts = deal(documents, n_blocks)

    def first(table: pa.Table) -> pa.Table:
        return minimizer_messages(Segments(Texts(table), length), bits)

    def second(table: pa.Table, wanted: pa.Table) -> pa.Table:
        if not len(table) or not len(wanted):
            return _table([])
        seg = Segments(Texts(table), length)
        return Ranked(seg, wanted, bits).messages(seg.texts)

    def third(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return results(Segments(Texts(table), length), np.empty(0, bool), with_text)
        seg, kind = Segments(Texts(table), length), np.array(answers.column("kind").to_pylist(), object)
        sent = Ranked(seg, answers.filter(pa.array(kind == "held", pa.bool_())), bits)
        return results(seg, removed(seg.texts, sent, answers.filter(pa.array(kind == "mask", pa.bool_()))), with_text)

    held = regroup(texts.groupBy("block").applyInArrow(first, MESSAGE), "bucket", n, minimizer_answers, MESSAGE).repartition(n, "block")
    segments = texts.groupBy("block").cogroup(held.groupBy("block")).applyInArrow(second, MESSAGE)
    masks = regroup(segments, "bucket", n, sorted_answers(length), MESSAGE)
    both = held.withColumn("kind", F.lit("held")).unionByName(masks.withColumn("kind", F.lit("mask"))).repartition(n, "block")
    return texts.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(third, RESULT + (", kept binary" if with_text else ""))


digest = remove_repeats
