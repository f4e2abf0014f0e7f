"""Token ids as raw binary shards with a minimal perfect hash index.

A store is a folder of shards, in ascending doc_id order or in the order of another numeric column (a mixture's positions).
`shard-N-*.ids` is nothing but ids, little-endian, 2 bytes each if the vocabulary fits and else 4. `shard-N-*.idx` holds, by
row of the shard, the key and where its ids start, and a minimal perfect hash from key to row with 32-bit fingerprints.
Documents are dealt to shards by ranges with fixed bounds (common.Ranges), one shuffle of the texts; each task streams its
rows through the tokenizer into one shard. Files carry the name of the attempt that wrote them, and the manifest names those
of the attempts that count, so retried or doubled tasks do no harm; what other attempts left is deleted. `Store.get` finds
the shards whose key range holds a document, one if shards are in doc_id order, and the document by one hash lookup.

Tokenizing goes by chunks of the text that no pre-token of the byte-level pattern spans (segments.chunk_starts), each
encoded once per worker while it stays in a bounded cache. The chunks' ids, put together, are those of the whole text;
tests hold this against the tokenizer itself.

Defined cases: a null or empty text is just the end id; rows with a null doc_id come first and aren't indexed; a repeated
doc_id is written as often as it occurs (equal ids in the order of text hash), maybe over several shards, and its key finds
the first; very long texts are encoded in pieces of whole chunks; an empty table makes an empty store. Other columns are
ignored.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm.common import SLICE_BYTES, filesystem, fresh_dir, in_ranges, map_arrow, slices, utf8
from skeinwork.llm.perfect_hash import PerfectHash, packed, unpacked
from skeinwork.llm.segments import chunk_starts, distinct, gather

SHARD_BYTES, CACHE_CHUNKS, END_ID, WINDOW_IDS = 16 << 20, 800_000, 2, 4 << 20
MANIFEST = "shard int, file string, n_rows long, n_tokens long, low long, high long, width int"
_MANIFEST = pa.schema([("shard", pa.int32()), ("file", pa.string()), ("n_rows", pa.int64()), ("n_tokens", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("width", pa.int32())])


class Encoder:
    """Ids of whole texts, by distinct chunks; a bounded cache keeps chunks between slices."""

    def __init__(self, path: str, dtype: np.dtype, most: int = CACHE_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model, self.dtype, self.most = Tokenizer.from_file(path), dtype, most
        self.known: dict[bytes, bytes] = {}
        self.special = [t.content.encode() for t in self.model.get_added_tokens_decoder().values()]

    def _starts(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Chunk starts; a text that holds a special token's string is one chunk, for the tokenizer to see it."""
        starts, body, whole = chunk_starts(data, offs), data.tobytes(), set()
        for content in self.special:
            at = body.find(content)
            while at >= 0:
                k = int(np.searchsorted(offs, at, "right")) - 1
                whole.add(k)
                at = body.find(content, int(offs[k + 1]))
        for k in sorted(whole):
            starts = starts[(starts <= offs[k]) | (starts >= offs[k + 1])]
        return starts

    def encode(self, data: np.ndarray, offs: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a slice, each with the end id behind it, and the number of ids of each text."""
        starts = self._starts(data, offs)
        lengths = np.diff(starts, append=len(data))
        chunks, of = distinct(data, starts, lengths)
        new = [c for c in chunks if c not in self.known]
        if len(self.known) + len(new) > self.most:
            self.known.clear()
            new = chunks
        made = self.model.encode_batch_fast([c.decode() for c in new], add_special_tokens=False)
        self.known.update((c, np.array(e.ids, self.dtype).tobytes()) for c, e in zip(new, made, strict=True))
        ids = [self.known[c] for c in chunks]
        sizes = np.array([*map(len, ids), self.dtype.itemsize], np.int64) // self.dtype.itemsize
        pool = np.frombuffer(b"".join(ids) + np.array([end_id], self.dtype).tobytes(), self.dtype)
        units = np.insert(of, np.searchsorted(starts, offs[1:]), len(chunks))
        taken = sizes[units]
        ends = np.searchsorted(starts, offs[1:]) + np.arange(1, len(offs))
        total = np.concatenate(([0], np.cumsum(taken)))[ends]
        return pool[gather((np.cumsum(sizes) - sizes)[units], taken)], np.diff(total, prepend=0)

    def pieces(self, data: np.ndarray, offs: np.ndarray, end_id: int, most: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, int]]:
        """encode() of one very long text, in runs of whole chunks: ids and their number, one run after another."""
        starts = self._starts(data, offs)
        cuts = np.unique(starts[np.searchsorted(starts, np.arange(most, len(data), most), "right") - 1])
        ends = [*cuts[cuts > 0].tolist(), len(data)]
        for a, b in zip([0, *ends], ends):
            ids, sizes = self.encode(data[a:b], np.array([0, b - a]), end_id)
            last = b == len(data)
            yield ids if last else ids[:-1], int(sizes[0]) - (not last)


_encoders: dict[tuple, Encoder] = {}


def _encoder(path: str, dtype: str) -> Encoder:
    if (path, dtype) not in _encoders:
        _encoders[path, dtype] = Encoder(path, np.dtype(dtype))
    return _encoders[path, dtype]


def id_dtype(tokenizer_path: str, end_id: int) -> str:
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def _put(fs, path: str, blob: bytes) -> None:
    with fs.open_output_stream(path) as f:
        f.write(blob)


def write(documents: DataFrame, out_dir: str, tokenizer_path: str, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES, order: str = "doc_id", keys: DataFrame | None = None) -> DataFrame:
    """Write a store in the order of a numeric column; the manifest, a row per shard."""
    dtype = id_dtype(tokenizer_path, end_id)
    ranged, n = in_ranges(documents, order, shard_bytes, keys)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, encoder = TaskContext.get().partitionId(), _encoder(tokenizer_path, dtype)
        fs, root = filesystem(out_dir)
        file = f"shard-{number:06d}-{uuid.uuid4().hex}"
        keys, lengths, out = [], [], None
        for b in batches:
            data, offs = utf8(b.column("text"))
            for _, _, part, o in slices(data, offs):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{file}.ids")
                if len(part) > 2 * SLICE_BYTES:  # one text
                    total = 0
                    for ids, size in encoder.pieces(part, o, end_id):
                        out.write(ids.tobytes())
                        total += size
                    lengths.append(np.array([total]))
                else:
                    ids, sizes = encoder.encode(part, o, end_id)
                    out.write(ids.tobytes())
                    lengths.append(sizes)
            keys.append(b.column("doc_id"))
        if out is None:
            return
        out.close()
        key = pa.chunked_array(keys).combine_chunks()
        valid = key.is_valid().to_numpy(zero_copy_only=False)
        key = key.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.concatenate(([0], np.cumsum(np.concatenate(lengths), dtype=np.int64)))
        rows = np.flatnonzero(valid)
        known, first = np.unique(key[rows], return_index=True)
        index = PerfectHash.build(known)
        row_of = np.empty(len(known), np.int64)
        row_of[index.lookup(known)] = rows[first]
        _put(fs, f"{root}/{file}.idx", packed({"keys": key, "valid": valid, "offsets": starts, "row_of": row_of, "width": np.array(np.dtype(dtype).itemsize), **index.arrays()}))
        low, high = (int(known[0]), int(known[-1])) if len(known) else (None, None)
        made = (number, file, len(key), int(starts[-1]), low, high, np.dtype(dtype).itemsize)
        yield pa.RecordBatch.from_pylist([dict(zip(_MANIFEST.names, made, strict=True))], _MANIFEST)

    dealt = ranged.repartitionById(n, "range").sortWithinPartitions("at", "hash").select("doc_id", "text")
    return map_arrow(dealt, shard, MANIFEST)


def clean(out_dir: str, manifest: list) -> None:
    """Delete what attempts left that don't count."""
    from pyarrow import fs as pafs

    fs, root = filesystem(out_dir)
    counts = {r["file"] + kind for r in manifest for kind in (".ids", ".idx")}
    for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        if f.base_name.startswith("shard-") and f.base_name not in counts:
            fs.delete_file(f.path)


class Shard:
    """One shard's index and, on demand, its ids."""

    def __init__(self, out_dir: str, file: str):
        self.fs, root = filesystem(out_dir)
        self.path = f"{root}/{file}"
        with self.fs.open_input_stream(self.path + ".idx") as f:
            self.index = unpacked(f.read())
        self.hash = PerfectHash(self.index["words"], self.index["starts"], self.index["prints"])
        self.dtype = np.dtype(f"<u{int(self.index['width'])}")

    def rows(self, keys: np.ndarray) -> np.ndarray:
        slots = self.hash.lookup(keys)
        return np.where(slots >= 0, self.index["row_of"][slots] if len(self.index["row_of"]) else -1, -1)

    def ids(self, row: int) -> np.ndarray:
        a, b = (int(x) * self.dtype.itemsize for x in self.index["offsets"][row : row + 2])
        with self.fs.open_input_file(self.path + ".ids") as f:
            return np.frombuffer(f.read_at(b - a, a), self.dtype)

    def crcs(self, rows: np.ndarray) -> list[int]:
        """The CRC of each row's ids as 4-byte integers; reads a window of the file at a time."""
        offs, wide, out, k = self.index["offsets"], self.dtype.itemsize, [], 0
        with self.fs.open_input_file(self.path + ".ids") as f:
            while k < len(rows):
                run = np.flatnonzero((rows[k + 1 :] != rows[k:-1] + 1) | (offs[rows[k + 1 :] + 1] - offs[rows[k]] > WINDOW_IDS))
                end = k + 1 + int(run[0]) if len(run) else len(rows)
                a, b = offs[rows[k]], offs[rows[end - 1] + 1]
                ids = np.frombuffer(f.read_at(int(b - a) * wide, int(a) * wide), self.dtype)
                out += [zlib.crc32(ids[offs[r] - a : offs[r + 1] - a].astype("<u4").tobytes()) for r in rows[k:end].tolist()]
                k = end
        return out


class Store:
    """Keyed access on one machine: shards by key range, row by perfect hash."""

    def __init__(self, out_dir: str, manifest: list):
        self.dir, self.open = out_dir, {}
        self.shards = [(r["low"], r["high"], r["file"]) for r in sorted(manifest, key=lambda r: r["shard"]) if r["low"] is not None]

    def get(self, doc_id: int) -> np.ndarray | None:
        for low, high, file in self.shards:
            if low <= doc_id <= high:
                if file not in self.open:
                    self.open[file] = Shard(self.dir, file)
                row = int(self.open[file].rows(np.array([doc_id]))[0])
                if row >= 0:
                    return self.open[file].ids(row)
        return None


ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, row long"


def read(spark: SparkSession, out_dir: str, manifest: list) -> DataFrame:
    """A row per document, from the files: where its ids start among all, how many, and their CRC as 4-byte integers.

    Each key's place comes from the perfect hash; rows without a key of their own (null or repeated doc_ids) follow the
    offsets. manifest: the collected rows of write(), one for each shard (some 100 bytes each, common.Ranges.MOST shards
    at most)."""
    spans, base = [], 0
    for r in sorted(manifest, key=lambda r: r["shard"]):
        spans.append((r["shard"], r["file"], base))
        base += r["n_tokens"]
    plan = spark.createDataFrame(spans, "shard int, file string, base long")
    plan = plan.repartition(len(spans)) if spans else plan

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, file, base in zip(*(b.column(c).to_pylist() for c in ("shard", "file", "base")), strict=True):
                shard = Shard(out_dir, file)
                offs, keys, valid = shard.index["offsets"], shard.index["keys"], shard.index["valid"]
                first = np.zeros(len(keys), bool)
                some = np.flatnonzero(valid)
                first[some[np.unique(keys[some], return_index=True)[1]]] = True
                at = np.arange(len(keys))
                at[first] = shard.rows(keys[first])
                if np.any(at < 0) or np.any(keys[at] != keys):
                    raise ValueError(f"shard {number}: the index doesn't lead to its keys")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, mask=~valid), pa.array(base + offs[at]), pa.array(offs[at + 1] - offs[at]), pa.array(shard.crcs(at), pa.int64()), pa.array(np.full(len(keys), number, np.int32)), pa.array(at)],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "shard", "row"],
                )

    return map_arrow(plan, rows, ROWS)


def tokenize(documents: DataFrame, tokenizer_path: str, end_id: int = END_ID, out_dir: str | None = None, order: str = "doc_id", keys: DataFrame | None = None) -> DataFrame:
    """Write a store (in the shared folder unless told where) in the order of a numeric column, and read it back.

    keys: as of common.in_ranges()."""
    spark = documents.sparkSession
    out_dir = out_dir or fresh_dir(spark, "tokens")
    manifest = write(documents, out_dir, tokenizer_path, end_id, order=order, keys=keys).collect()
    clean(out_dir, manifest)
    return read(spark, out_dir, manifest)
