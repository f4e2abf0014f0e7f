"""Removal of lines that repeat across documents, by a sharded minimal perfect hash over the distinct lines.

A line's key is the line without white space at both ends, A-Z in lower case; keys of at least `chars` code points take
part, as 128 bits of their hash. The index is a row per shard: a minimal perfect hash of the shard's distinct keys
(perfect_hash: bits in levels, 32-bit fingerprints), and by slot the number of documents that hold the key and the largest
doc_id among them. Documents don't join lines: a block of documents (blocks.py) sends a shard its distinct keys as one
packed array, the shard looks all of them up in its arrays and answers with the places of those that repeat and their
largest doc_id, and the block drops lines by that.

Scale: one exchange of the texts; each block tells a shard each key once, however many of its documents hold it, in 28
bytes; answers hold repeated keys only. A shard has the keys of some four blocks, at any size of the input. A line that a
third of all documents hold is one entry a block.

Defined cases: a null or empty text is one empty line. Rows equal in doc_id and text are one document, which is counted once
and keeps or loses its lines in every row; other texts of the same doc_id count as documents of their own. Rows without a
doc_id count as documents, but never hold the largest one: they lose a repeated line if any row with a doc_id holds it, and
if none does, all keep it. A line repeated within one document counts once, and all its copies go or stay. Ties can't be:
all rows of the largest doc_id keep the line. Very long texts and lines are held whole by one task, one at a time beside a
block's other few MB. An empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.blocks import Texts, bounds, deal, partitions, regroup, sizes
from skeinwork.llm.common import LOWER, UPPER, mix64
from skeinwork.llm.perfect_hash import PerfectHash, packed, unpacked

CHARS, DOCUMENTS = 20, 3
MESSAGE = "block int, shard int, payload binary"
_MESSAGE = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("payload", pa.binary())])
NOBODY = np.iinfo(np.int64).min
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


def line_keys(text: bytes, chars: int) -> list[bytes | None]:
    """The 128-bit hash of each line's key, None for lines that are too short to take part."""
    found: list[bytes | None] = []
    for line in text.translate(_LOWER).split(b"\n"):
        key = line.strip(_SPACE)
        long_enough = len(key) >= chars and (key.isascii() or len(key.decode()) >= chars)
        found.append(xxhash.xxh3_128_digest(key) if long_enough else None)
    return found


class Lines:
    """A block's lines: by document row their keys, and the distinct keys in the order in which shards are told of them."""

    def __init__(self, table: pa.Table, n_shards: int, chars: int):
        self.texts = Texts(table)
        t = self.texts
        body = t.data.tobytes()
        self.rows = [body[a:b] for a, b in zip(t.offs[:-1].tolist(), t.offs[1:].tolist(), strict=True)]
        keys = [line_keys(x, chars) for x in self.rows]
        self.sizes = [len(k) for k in keys]
        flat = [k for row in keys for k in row]
        self.held = np.array([k is not None for k in flat], bool)
        digest = np.frombuffer(b"".join(k for k in flat if k is not None), np.uint64).reshape(-1, 2)
        new = [k == 0 or not (t.ids[k] == t.ids[k - 1] and t.known[k] == t.known[k - 1] and self.rows[k] == self.rows[k - 1]) for k in range(len(self.rows))]
        row = np.repeat(np.arange(len(self.rows)), self.sizes)[self.held]
        document = np.cumsum(new)[row] if len(row) else row
        shard = (mix64(digest[:, 0] ^ digest[:, 1]) % np.uint64(n_shards)).astype(np.int64)
        order = np.lexsort((document, digest[:, 0], digest[:, 1], shard))
        d = digest[order]
        first = np.ones(len(d), bool)
        first[1:] = (d[1:] != d[:-1]).any(1)
        begin = np.flatnonzero(first)
        fresh = first.copy()
        fresh[1:] |= document[order][1:] != document[order][:-1]
        ids = np.where(t.known[row], t.ids[row], NOBODY)[order]
        self.key, self.shard = d[begin], shard[order][begin]
        self.documents = np.add.reduceat(fresh.astype(np.uint32), begin) if len(begin) else np.empty(0, np.uint32)
        self.last = np.maximum.reduceat(ids, begin) if len(begin) else np.empty(0, np.int64)
        self.entry = np.empty(len(d), np.int64)  # by line that takes part
        self.entry[order] = np.cumsum(first) - 1
        self.id = np.where(t.known[row], t.ids[row], NOBODY)


def messages(lines: Lines) -> pa.Table:
    rows = []
    for s, x, y in bounds(lines.shard):
        rows.append((lines.texts.block, s, lines.key[x:y].tobytes() + lines.last[x:y].tobytes() + lines.documents[x:y].astype(np.uint32).tobytes()))
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 3, _MESSAGE, strict=True)], schema=_MESSAGE)


def _told(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(blob) // 28
    return np.frombuffer(blob, np.uint64, 2 * n).reshape(-1, 2), np.frombuffer(blob, np.int64, n, 16 * n), np.frombuffer(blob, np.uint32, n, 24 * n)


def _slot_keys(key: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(mix64(key[:, 0] + np.uint64(seed)) ^ key[:, 1]).view(np.int64)


class LineIndex:
    """One shard: slots of its distinct keys, and by slot the documents that hold the key and the largest doc_id."""

    def __init__(self, seed: int, slots: PerfectHash, documents: np.ndarray, last: np.ndarray):
        self.seed, self.slots, self.documents, self.last = seed, slots, documents, last

    @classmethod
    def build(cls, blobs: list[bytes]) -> LineIndex:
        told = [_told(x) for x in blobs]
        key, last, documents = (np.concatenate(x) for x in zip(*told, strict=True))
        order = np.lexsort((key[:, 0], key[:, 1]))
        key = key[order]
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]).any(1)
        begin = np.flatnonzero(first)
        seed, distinct = 0, key[begin]
        while len(np.unique(_slot_keys(distinct, seed))) < len(distinct):
            seed += 1  # 64 bits that tell all 128-bit keys of the shard apart
        own = _slot_keys(distinct, seed)
        slots = PerfectHash.build(own)
        at = slots.lookup(own)
        made = cls(seed, slots, np.empty(len(own), np.int64), np.empty(len(own), np.int64))
        made.documents[at] = np.add.reduceat(documents[order].astype(np.int64), begin)
        made.last[at] = np.maximum.reduceat(last[order], begin)
        return made

    def pack(self) -> bytes:
        return packed({"seed": np.array(self.seed), "documents": self.documents, "last": self.last, **self.slots.arrays()})

    @classmethod
    def unpack(cls, blob: bytes) -> LineIndex:
        a = unpacked(blob)
        return cls(int(a["seed"]), PerfectHash(a["words"], a["starts"], a["prints"]), a["documents"], a["last"])

    def probe(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By key: the documents that hold it (0 if the index doesn't have it), and the largest doc_id (NOBODY: none)."""
        at = self.slots.lookup(_slot_keys(key, self.seed))
        found = at >= 0
        documents, last = np.zeros(len(key), np.int64), np.full(len(key), NOBODY)
        documents[found], last[found] = self.documents[at[found]], self.last[at[found]]
        return documents, last


def index(told: DataFrame, n_shards: int) -> DataFrame:
    """The index of what blocks told: shard, payload (LineIndex.pack), a row per shard that has a key."""

    def build(table: pa.Table) -> Iterator[pa.RecordBatch]:
        blob = LineIndex.build(table.column("payload").to_pylist()).pack()
        yield pa.RecordBatch.from_arrays([pa.array([table.column("shard")[0].as_py()], pa.int32()), pa.array([blob], pa.binary())], names=["shard", "payload"])

    return regroup(told, "shard", n_shards, build, "shard int, payload binary")


def without_repeats(documents: DataFrame, chars: int = CHARS, least: int = DOCUMENTS, with_text: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of each row, and (with_text) the remaining lines as `kept`."""
    n_blocks = sizes(documents)
    n = partitions(n_blocks)
    texts = deal(documents, n_blocks)

    def tell(table: pa.Table) -> pa.Table:
        return messages(Lines(table, n, chars))

    def answer(told: pa.Table, index_rows: pa.Table) -> pa.Table:
        rows = []
        found = LineIndex.unpack(index_rows.column("payload")[0].as_py()) if len(index_rows) else None
        for block, shard, blob in zip(*(told.column(c).to_pylist() for c in ("block", "shard", "payload")), strict=True):
            n_documents, last = found.probe(_told(blob)[0])
            at = np.flatnonzero((n_documents >= least) & (last != NOBODY))
            if len(at):
                rows.append((block, shard, last[at].tobytes() + at.astype(np.uint32).tobytes()))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 3, _MESSAGE, strict=True)], schema=_MESSAGE)

    def drop(table: pa.Table, answers: pa.Table) -> pa.Table:
        lines = Lines(table, n, chars) if len(table) else None
        return results(lines, answers, with_text)

    told = texts.groupBy("block").applyInArrow(tell, MESSAGE).repartition(n, "shard")
    answers = told.groupBy("shard").cogroup(index(told, n).repartition(n, "shard").groupBy("shard")).applyInArrow(answer, MESSAGE).repartition(n, "block")
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(drop, RESULT + (", kept string" if with_text else ""))


RESULT = "doc_id long, n_lines long, n_dropped long, kept_sha256 string"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])


def results(lines: Lines | None, answers: pa.Table, with_text: bool) -> pa.Table:
    schema = _RESULT.append(pa.field("kept", pa.string())) if with_text else _RESULT
    rows = []
    if lines is not None:
        last = np.full(len(lines.key), NOBODY)
        begin = {s: x for s, x, _ in bounds(lines.shard)}
        for shard, blob in zip(answers.column("shard").to_pylist(), answers.column("payload").to_pylist(), strict=True):
            n = len(blob) // 12
            last[begin[shard] + np.frombuffer(blob, np.uint32, n, 8 * n).astype(np.int64)] = np.frombuffer(blob, np.int64, n)
        goes = np.zeros(len(lines.held), bool)
        goes[lines.held] = lines.id < last[lines.entry]
        at = 0
        for k, (text, size) in enumerate(zip(lines.rows, lines.sizes, strict=True)):
            gone = goes[at : at + size]
            at += size
            kept = text if not gone.any() else b"\n".join(x for x, g in zip(text.split(b"\n"), gone.tolist(), strict=True) if not g)
            doc_id = int(lines.texts.ids[k]) if lines.texts.known[k] else None
            rows.append((doc_id, size, int(gone.sum()), hashlib.sha256(kept).hexdigest()) + ((kept.decode(),) if with_text else ()))
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


digest = without_repeats

ORACLE_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents),
keyed AS (
  SELECT *, trim(translate(line, '{UPPER}', '{LOWER}'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM lines),
repeated AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= {CHARS}
  GROUP BY key HAVING count(DISTINCT doc_id) >= {DOCUMENTS}),
judged AS (
  SELECT doc_id, line, place, coalesce(doc_id < last, false) AS gone
  FROM keyed LEFT JOIN repeated USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
