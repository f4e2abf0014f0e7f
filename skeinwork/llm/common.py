"""Helpers that the training-data operators share: tables, durable checkpoints and Arrow text views."""

from __future__ import annotations

import contextlib
import ctypes
import inspect
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.session import checkpointed, shared_dir

__all__ = ["checkpointed", "shared_dir"]

#: Text bytes that Python works on at once; numpy temporaries are a few times this.
SLICE_BYTES = 4 << 20
BATCH_ROWS = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def released(run: Callable) -> Callable:
    """A map over batches that gets them in pieces of BATCH_ROWS rows, which suits long texts whatever the session's batches
    are, and gives freed memory back at its end: workers are kept for later tasks."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, max(1, len(b)), BATCH_ROWS):
                yield b.slice(k, BATCH_ROWS)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(pieces(batches))
        finally:
            give_back()

    return walk


def give_back() -> None:
    """Give freed memory back to the machine: a Python worker is kept for later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def trimmed(run: Callable) -> Callable:
    """A function of one group, or of two that go together, that gives freed memory back behind each."""

    def one(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            give_back()

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return run(left, right)
        finally:
            give_back()

    return one if len(inspect.signature(run).parameters) == 1 else two


def prepared(spark: SparkSession) -> SparkSession:
    """The session of the registered queries and pipeline stages, with Arrow batches that suit long texts where it has Spark's
    own default. Operators never change a session; their callers choose its batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, BATCH_ROWS)
    return spark


def map_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """mapInArrow with pieces of batches that suit long texts."""
    return df.mapInArrow(released(run), schema)


def own_name(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have, for helpers beside a caller's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns(df: DataFrame, names: list[str] | None = None) -> list:
    """Columns by their whole names, whatever is in them."""
    return [F.col(f"`{c}`") for c in (df.columns if names is None else names)]


def fresh_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def filesystem(uri: str):
    """The pyarrow file system of a URI or path, and the path in it; works wherever pyarrow does."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def ascii_lower(col):
    """A-Z only: other letters keep their case, unlike lower()."""
    return F.translate(col, UPPER, LOWER)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a string column one after another, and their n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n, at = len(column), column.offset
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind, n + 1, at * np.dtype(kind).itemsize).astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return body[offs[0] : offs[-1]], offs - offs[0]


def slices(data: np.ndarray, offs: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of at most `most` bytes (a longer text comes alone): first, end, bytes, offsets."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


class Ranges:
    """Where ranges of rows in one order end: fixed values, so that every read of them agrees on every row's range.

    The order is by a numeric column, nulls first, and then by a hash, so that rows of equal value spread, too. Bounds are
    quantiles by bytes of a sample of the rows' keys, some 30 a range (10, where ranges are very many), chosen by hash."""

    # sampled rows a range, and of all ranges (at least 10 a range); ranges, whose bounds the driver holds: beyond, ranges grow
    SAMPLE, SAMPLED, MOST = 30, 1_000_000, 100_000

    def __init__(self, keys: DataFrame, wished: int):
        """keys: at (numeric), hash (long), bytes (long)."""
        self.n = max(1, min(wished, self.MOST))
        self.bounds = np.empty((0, 2))
        if self.n > 1:
            rows = keys.count()
            place = F.pmod(F.xxhash64(F.lit("range"), "at", "hash"), F.lit(1 << 30)) / F.lit(1 << 30)
            found = keys.where(place < min(1.0, self.n * max(10, min(self.SAMPLE, self.SAMPLED // self.n)) / max(1, rows))).select("at", "hash", "bytes").collect()
            found.sort(key=lambda r: (r["at"] is not None, r["at"] or 0, r["hash"]))
            ends = np.cumsum([r["bytes"] + 1 for r in found], dtype=np.float64)
            cut = np.unique(np.searchsorted(ends, np.arange(1, self.n) * (ends[-1] / self.n if len(ends) else 0))).tolist()
            self.bounds = [(found[k]["at"], found[k]["hash"]) for k in cut if k < len(found)]
            self.n = len(self.bounds) + 1
        self.nulls = sum(a is None for a, _ in self.bounds)
        self.at = np.array([a for a, _ in self.bounds if a is not None])
        self.hash = np.array([h for _, h in self.bounds], np.int64)

    def of(self, at: np.ndarray, known: np.ndarray, hash_: np.ndarray) -> np.ndarray:
        """The range of each row; a bound is the last key of its range."""
        first, end = np.zeros(len(at), np.int64), np.full(len(at), self.nulls)
        if len(self.at):
            first[known], end[known] = (np.searchsorted(self.at, at[known], side) + self.nulls for side in ("left", "right"))
        else:
            first[known] = end[known] = self.nulls
        for k in np.flatnonzero(end > first):  # bounds of equal value: the hash decides
            first[k] += np.searchsorted(self.hash[first[k] : end[k]], hash_[k])
        return first

    def column(self, at, hash_):
        """The range as a column, from two numeric columns (no text goes to Python)."""

        @F.pandas_udf("int")
        def number(at: pd.Series, known: pd.Series, hash_: pd.Series) -> pd.Series:
            return pd.Series(self.of(at.to_numpy(), known.to_numpy(bool), hash_.to_numpy(np.int64)).astype(np.int32))

        return number(F.coalesce(at, F.lit(0)), at.isNotNull(), hash_) if self.n > 1 else F.lit(0)


def in_ranges(documents: DataFrame, order: str, range_bytes: int, keys: DataFrame | None = None) -> tuple[DataFrame, int]:
    """doc_id, at, hash, text, range of each row; and the number of ranges. Rows are neither dealt nor sorted yet.

    order: a numeric column that becomes `at`; null texts become empty. keys: at, hash (range_hash()) and bytes of the rows,
    where there is a cheaper way to them than through `documents`."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(order).alias("at"), range_hash().alias("hash"), text.alias("text"))
    keys = rows.select("at", "hash", F.octet_length("text").cast("long").alias("bytes")) if keys is None else keys
    ranges = Ranges(keys, -(-int(keys.agg(F.sum("bytes")).first()[0] or 0) // range_bytes))
    return rows.withColumn("range", ranges.column(F.col("at"), F.col("hash"))), ranges.n


def range_hash():
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))


def text_bytes(df: DataFrame) -> int:
    """Bytes of all texts; one narrow aggregate."""
    return int(df.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), on uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
