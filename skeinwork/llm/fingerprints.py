"""Document fingerprints by content-defined chunking.

A gear hash over the last 8 bytes marks chunk ends, normalised: few places qualify before the wished size and many after
it, so sizes keep near it. Chunk ends depend on nearby bytes only; an insertion shifts text without changing the chunks
behind it. A fingerprint is the set of chunk digests, each with its chunk's length (56 and 8 bits), and the likeness of A
to B is the containment of A in B: the share of A's length whose chunks B has.

Neighbours in doc_id order are compared without a global sort of texts: one shuffle deals documents to ranges of doc_id with
fixed bounds (common.Ranges), and each task walks its sorted rows with the next one at hand. The keys of the first and last
row of each range are found from the same bounds; their texts (two a range) meet in a second, small step.

Defined cases: null texts count as empty; empty texts have the empty fingerprint, which is like (1.0) another empty one and
unlike (0.0) any other; rows with a null doc_id come first; rows of equal doc_id follow each other by text hash, may
lie in several ranges, and each gives a row; very long texts are chunked in windows; a single row is its own neighbour; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import SLICE_BYTES, in_ranges, map_arrow, slices, utf8
from skeinwork.llm.segments import _random, hashes

LEAST, WISHED, MOST = 8, 28, 80
STRONG, LOOSE = np.uint32(0xFC000000), np.uint32(0xE0000000)  # one place in 64, one in 8
RANGE_BYTES = 16 << 20
_GEAR = (_random(256, 1 << 44) >> np.uint64(32)).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The hash of the 8 bytes that end at each place, by doubling: four bits further for each byte back."""
    h = _GEAR[data]
    for width in (1, 2, 4):
        h[width:] += h[:-width] << np.uint32(4 * width)
    return h


def chunks(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunk ends over all texts of a slice, and how many chunks each text has."""
    h = gear(data)
    loose = np.flatnonzero((h & LOOSE) == 0)
    strong = loose[(h[loose] & STRONG) == 0].tolist()
    loose = loose.tolist()
    ends, counts = [], []
    for p, end in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        before = len(ends)
        while p < end:
            wished, most = p + WISHED - 1, p + MOST - 1
            k = bisect_left(strong, p + LEAST - 1)
            if k < len(strong) and strong[k] < wished:
                p = strong[k] + 1
            else:
                k = bisect_left(loose, wished)
                p = loose[k] + 1 if k < len(loose) and loose[k] < most else most + 1
            ends.append(min(p, end))
        counts.append(len(ends) - before)
    return np.array(ends, np.int64), np.array(counts, np.int64)


def _windows(data: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunk ends of one very long text, window by window: the window and the ends in it. A chunk's end depends on nothing
    before the chunk, as the first eight bytes of a chunk hold no end, so the next window begins at the last whole chunk's."""
    p = 0
    while p < len(data):
        window = data[p : p + most]
        ends, _ = chunks(window, np.array([0, len(window)]))
        if p + most < len(data):
            ends = ends[ends <= most - MOST]
        yield window[: ends[-1]], ends
        p += int(ends[-1])


def _entries(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    length = ends - starts
    return hashes(data, starts, length) & ~np.uint64(255) | length.astype(np.uint64)


def fingerprints(data: np.ndarray, offs: np.ndarray, most: int = SLICE_BYTES) -> list[np.ndarray]:
    """Each text's sorted distinct entries: digest in the upper 56 bits, chunk length in the lower 8."""
    if len(offs) == 2 and len(data) > most:
        return [np.unique(np.concatenate([np.unique(_entries(part, ends)) for part, ends in _windows(data, most)]))]
    ends, counts = chunks(data, offs)
    entries, at = _entries(data, ends), np.cumsum(counts) - counts
    return [np.unique(entries[a : a + n]) for a, n in zip(at.tolist(), counts.tolist(), strict=True)]


def weight(entries: np.ndarray) -> int:
    return int((entries & np.uint64(255)).sum())


def containment(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a):
        return float(not len(b))
    return weight(np.intersect1d(a, b, assume_unique=True)) / weight(a)


def shown(entries: np.ndarray) -> str:
    return base64.b64encode(entries.astype("<u8").tobytes()).decode()


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _of(texts: list[str]) -> list[np.ndarray]:
    column = pa.array(texts, pa.large_string())
    return [x for _, _, part, o in slices(*utf8(column)) for x in fingerprints(part, o)]


_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string())]
    + [("near_edited", pa.float64()), ("near_next", pa.float64())]
)
DIGEST = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def _compared(ids: list, texts: list[str], prints: list[np.ndarray]) -> list[tuple]:
    """Result rows of all but the last text."""
    new = [edited(a, b) for a, b in zip(texts, texts[1:])]
    rows = []
    for k, e in enumerate(_of(new)):
        sha = hashlib.sha256(new[k].encode()).hexdigest()
        rows.append((ids[k], len(texts[k]), sha, shown(prints[k]), shown(e), containment(prints[k], e), containment(prints[k], prints[k + 1])))
    return rows


def _seams(ranged: DataFrame) -> list[tuple]:
    """range, doc_id and hash of the last row of each range that has rows, and the same of the first row behind it.

    Nothing but two keys a range goes to the driver; ranges are common.Ranges.MOST at most."""
    key = F.struct(F.col("doc_id").isNotNull(), "doc_id", "hash")
    found = sorted(ranged.groupBy("range").agg(F.min(key).alias("first"), F.max(key).alias("last")).collect())
    return [(k, *r["last"][1:], *found[(k + 1) % len(found)]["first"][1:]) for k, r in enumerate(found)]


def compare_neighbours(documents: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Fingerprints of each text and of its edited text, and likenesses, in doc_id order."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            data, offs = utf8(b.column("text"))
            ids = b.column("doc_id").to_pylist()
            for i, j, part, o in slices(data, offs):
                body, prints = part.tobytes(), fingerprints(part, o)
                texts = [body[x:y].decode() for x, y in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)]
                own = ids[i:j]
                if last is not None:
                    own, texts, prints = [last[0], *own], [last[1], *texts], [last[2], *prints]
                if rows := _compared(own, texts, prints):
                    yield _batch(rows)
                last = own[-1], texts[-1], prints[-1]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, text, following in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "following")), strict=True):
                yield _batch(_compared([doc_id, None], [text, following], _of([text, following])))

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranged, n = in_ranges(rows, "doc_id", range_bytes)
    dealt = ranged.select("doc_id", "hash", "text", "range").repartitionById(n, "range").sortWithinPartitions("doc_id", "hash")
    inner = map_arrow(dealt.select("doc_id", "text"), walk, DIGEST)
    seams = _seams(ranged.select("doc_id", "hash", "range"))
    ends = [(k, side, *key) for k, *keys in seams for side, key in enumerate((keys[:2], keys[2:]))]
    wanted = documents.sparkSession.createDataFrame(ends, "seam int, side int, id long, h long")  # two short rows a range
    at = ranged["doc_id"].eqNullSafe(wanted["id"]) & (ranged["hash"] == wanted["h"])
    both = ranged.select("doc_id", "hash", "text").join(F.broadcast(wanted), at).groupBy("seam")
    side = lambda c, k: F.first(F.when(F.col("side") == k, F.col(c)), ignorenulls=True)
    pairs = both.agg(side("doc_id", 0).alias("doc_id"), side("text", 0).alias("text"), side("text", 1).alias("following"))
    return inner.unionByName(map_arrow(pairs, meet, DIGEST))


digest = compare_neighbours
