"""Boxes from masks: pixels packed to bits, dealt by mask, and the opening, the runs and their parts by arrays of many masks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Half the side of the square by which a mask is opened.
REACH = 2


def _packed(threshold: int):
    """Rows of grey pixels as bits: over the threshold or not. Only these are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grey = batch.column("grey")
            size = np.diff(grey.offsets.to_numpy()).astype(np.int32)
            on = grey.flatten().to_numpy(zero_copy_only=False) > threshold  # a missing pixel isn't
            bits = np.zeros((len(batch), -(-int(size.max(initial=0)) // 8) * 8), np.uint8)
            bits[np.arange(bits.shape[1]) < size[:, None]] = on
            bits = np.packbits(bits, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("mask_id"), batch.column("y"), pa.array(size), pa.array([b.tobytes() for b in bits], pa.binary())], ["mask_id", "y", "size", "bits"])

    return run


def _spread(on: np.ndarray, there: np.ndarray, key: np.ndarray, least: bool) -> np.ndarray:
    """Each pixel as the least (or greatest) of the square around it; pixels outside of the mask don't count."""
    join = np.logical_and if least else np.logical_or
    filled = np.where(there, on, least)
    wide = np.pad(filled, ((0, 0), (REACH, REACH)), constant_values=least)
    across = filled.copy()
    for k in range(2 * REACH + 1):
        join(across, wide[:, k : k + on.shape[1]], out=across)
    across[~there] = least
    out = across.copy()
    for k in [k for k in range(-REACH, REACH + 1) if k]:
        at = np.minimum(np.searchsorted(key, key + k), len(key) - 1)
        rows = np.flatnonzero(key[at] == key + k)
        out[rows] = join(out[rows], across[at[rows]])
    return out & there


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of each one's component, by edges a, b between 0..n-1."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root[root] != root).any():
            root = root[root]
    return root


def _parts(mask: np.ndarray, y: np.ndarray, on: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of whole masks, rows in order: each part's first row of pixels, and x1, y1, x2, y2, pixels."""
    low = y.min(initial=0) - REACH
    key = mask * (y.max(initial=0) - low + 2 * REACH + 1) + (y - low)
    on = _spread(_spread(on, there, key, True), there, key, False)
    edge = np.diff(np.pad(on, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    (row, a), (_, b) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    # runs of the row above that touch, corners too: those that end at a or later and start at b or before
    above = np.minimum(np.searchsorted(key, key - 1), len(key) - 1)
    has, scale = (key[above] == key - 1)[row], on.shape[1] + 2
    first = np.searchsorted(row * scale + b, above[row] * scale + a)
    count = np.where(has, np.maximum(0, np.searchsorted(row * scale + a, above[row] * scale + b, "right") - first), 0)
    of = np.repeat(np.arange(len(row)), count)
    root = _joined(len(row), of, first[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count))
    by = np.argsort(root, kind="stable")
    heads = np.flatnonzero(np.diff(root[by], prepend=-1))
    if not len(heads):
        return (row[:0],) * 6
    lines = y[row[by]]
    return (
        row[by][heads], np.minimum.reduceat(a[by], heads), np.minimum.reduceat(lines, heads), np.maximum.reduceat(b[by], heads), np.maximum.reduceat(lines, heads) + 1,
        np.add.reduceat((b - a)[by], heads),
    )


def _boxes(least: int):
    """Boxes of sorted rows, whole masks at a time: the last mask of a batch waits for the next."""

    def found(table: pa.Table) -> pa.RecordBatch:
        size, bits = table.column("size").to_numpy(), table.column("bits").to_pylist()
        wide = max(len(x) for x in bits)
        rows = np.frombuffer(b"".join(x.ljust(wide, b"\0") for x in bits), np.uint8).reshape(len(bits), wide)
        on = np.unpackbits(rows, axis=1).astype(bool)
        ids = table.column("mask_id").combine_chunks()
        mask = ids.dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
        first, *box, pixels = _parts(mask, table.column("y").to_numpy().astype(np.int64), on, np.arange(on.shape[1]) < size[:, None])
        enough = pixels >= least
        return pa.RecordBatch.from_arrays([ids.take(pa.array(first[enough])), *(pa.array(c[enough].astype(np.int32)) for c in box), pa.array(pixels[enough].astype(np.int64))], ["mask_id", "x1", "y1", "x2", "y2", "pixels"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            ids = batch.column("mask_id").dictionary_encode(null_encoding="encode").indices.to_numpy()
            cuts = np.flatnonzero(ids[1:] != ids[:-1]) + 1
            if held and len(batch) and held[-1].column("mask_id")[-1].as_py() != batch.column("mask_id")[0].as_py():
                cuts = np.append(0, cuts)
            if len(cuts):
                done = [*held, *([batch.slice(0, cuts[-1])] if cuts[-1] else [])]
                yield found(pa.Table.from_batches(done))
                held, batch = [], batch.slice(cuts[-1])
            if len(batch):
                held.append(batch)
        if held:
            yield found(pa.Table.from_batches(held))

    return run


def mask_boxes(rows: DataFrame, threshold: int, least: int) -> DataFrame:
    """mask_id, x1, y1, x2, y2, pixels of the parts of `least` pixels or more, after an opening. rows: mask_id, y (every row of
    the mask), grey. Parts are runs that touch in adjacent rows, corners too.

    A row is shuffled as its bits; a task walks its masks in order and holds a batch and the mask that the batch ends in."""
    kind = f"mask_id {rows.schema['mask_id'].dataType.simpleString()}"
    packed = rows.where("grey is not null").select("mask_id", "y", "grey").mapInArrow(_packed(threshold), f"{kind}, y {rows.schema['y'].dataType.simpleString()}, size int, bits binary")
    return packed.repartition("mask_id").sortWithinPartitions("mask_id", "y").mapInArrow(_boxes(least), f"{kind}, x1 int, y1 int, x2 int, y2 int, pixels long")
