"""Blocks: the exchange pattern of the exact corpus-wide operators.

Documents are dealt once, by a hash of doc_id, to blocks of a few MB. A block tells buckets (of some hash space) what it
holds, each thing once however many of its documents hold it; buckets answer blocks, not documents. So a thing that a third
of all documents share is told once a block and answered once a block, and no task sees more than a block or a bucket.
Messages are packed arrays in binary columns, a row per block and bucket, which keeps rows few and shuffles small.

The same dealt texts serve every round: within one query Spark runs their exchange once and reuses it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import map_arrow, text_bytes
from skeinwork.operators.neardup import stars

BLOCK_BYTES = 4 << 20
NO_ID = np.iinfo(np.int64).max


def sizes(documents: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """How many blocks the texts make."""
    return max(1, -(-text_bytes(documents) // block_bytes))


def block_of(doc_id, text, n: int):
    """By both, so that rows without a doc_id, or of one, spread over blocks."""
    return F.pmod(F.xxhash64(F.lit("block"), doc_id, text), F.lit(n)).cast("int")


def partitions(n_blocks: int) -> int:
    """Tasks of a round: a block each while they are few, then four."""
    return max(min(n_blocks, 8), n_blocks // 4)


def deal(documents: DataFrame, n_blocks: int) -> DataFrame:
    """block, doc_id, text; null texts become empty."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("block", block_of(F.col("doc_id"), F.col("text"), n_blocks)).repartition(partitions(n_blocks), "block")


def regroup(rows: DataFrame, key: str, n: int, then: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Rows of a key together, as a table, one key at a time; keys stream through the task in order."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            keys = b.column(key).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for x, y in zip(cuts, cuts[1:]):
                if y == x:
                    continue
                if held and held[-1].column(key)[0].as_py() != keys[x]:
                    yield from then(pa.Table.from_batches(held))
                    held = []
                held.append(b.slice(x, y - x))
        if held:
            yield from then(pa.Table.from_batches(held))

    return map_arrow(rows.repartition(n, key).sortWithinPartitions(key), walk, schema)


class Texts:
    """A block's documents in a fixed order: by doc_id, then bytes; those without a doc_id come last (`known` is false)."""

    def __init__(self, table: pa.Table):
        texts = [x.encode() for x in table.column("text").to_pylist()]
        ids = table.column("doc_id").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
        self.block = table.column("block")[0].as_py() if len(ids) else None
        self.ids = np.array([NO_ID if ids[i] is None else ids[i] for i in order], np.int64)
        self.known = np.array([ids[i] is not None for i in order], bool)
        own = [texts[i] for i in order]
        self.offs = np.concatenate(([0], np.cumsum([len(t) for t in own], dtype=np.int64)))
        self.data = np.frombuffer(b"".join(own), np.uint8)


def bounds(sorted_buckets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Runs of equal values: value, first, end."""
    if not len(sorted_buckets):
        return
    cuts = [0, *(np.flatnonzero(sorted_buckets[1:] != sorted_buckets[:-1]) + 1).tolist(), len(sorted_buckets)]
    for a, b in zip(cuts, cuts[1:]):
        yield int(sorted_buckets[a]), a, b


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of the graph of edges a, b; nodes without an edge don't appear."""
    now = stars(edges)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
