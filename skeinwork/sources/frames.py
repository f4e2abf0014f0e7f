"""Recorded frames as a stream: a Python data source with offsets, admission, a frame limit and an end.

A recording is a Parquet folder with a row per frame: stream_id, frame (from 0), last (the stream's last frame) and its
detections. The source gives a row per detection, and one without a det_id for a processed frame that shows none.

Options: path; step (every step-th frame is processed); maxFrames (frames from there on aren't read); fps (30 where absent or
not above 0); framesPerBatch (how many frame numbers a micro-batch may take from every stream); checkpoint (the query's own
checkpoint folder: the offsets that it has planned tell where to go on, so that nothing is kept here); live (a recording that
still grows: it needs maxFrames, as it has no end of its own)."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "skeinwork_frames"
FPS = 30.0
DETECTIONS = "array<struct<det_id:long,class_id:int,confidence:double,x1:int,y1:int,x2:int,y2:int>>"
SCHEMA = "stream_id long, frame int, seconds double, last boolean, det_id long, class_id int, confidence double, x1 int, y1 int, x2 int, y2 int"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
BATCH = 2048  # frames that are read at once
BUFFER = 1 << 20  # bytes of a column that are read at once


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


class _Part(InputPartition):
    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        options = {k.lower(): v for k, v in options.items()}  # Spark's options know no case
        self.path, self.checkpoint = options["path"], options.get("checkpoint")
        self.step, self.batch = int(options.get("step", 1)), int(options.get("framesperbatch", 1000))
        self.most = int(options["maxframes"]) if options.get("maxframes") else None
        fps = float(options.get("fps", 0) or 0)
        self.fps = fps if fps > 0 else FPS
        if self.step < 1 or self.batch < 1:
            raise ValueError("step and framesPerBatch must be at least 1")
        if options.get("live", "false").lower() == "true" and self.most is None:
            raise ValueError("a live source needs maxFrames: it has no end of its own")

    def _files(self) -> list[str]:
        from pyarrow import fs as pafs

        fs, root = _filesystem(self.path)
        return sorted(f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.base_name.endswith(".parquet"))

    def _frames(self) -> int:
        """One more than the last frame that is there, by the files' own statistics."""
        import pyarrow.parquet as pq

        fs, _ = _filesystem(self.path)
        end = 0
        for path in self._files():
            with fs.open_input_file(path) as f:
                meta = pq.ParquetFile(f).metadata
            column = meta.schema.names.index("frame")
            end = max([end, *(meta.row_group(g).column(column).statistics.max + 1 for g in range(meta.num_row_groups) if meta.row_group(g).num_rows)])
        return end if self.most is None else min(end, self.most)

    def _planned(self) -> int:
        """The frame up to which the query has planned, by the last entry of its offset log."""
        from pyarrow import fs as pafs

        if not self.checkpoint:
            return 0
        fs, root = _filesystem(self.checkpoint)
        batches = [f for f in fs.get_file_info(pafs.FileSelector(f"{root}/offsets", allow_not_found=True)) if f.base_name.isdigit()]
        if not batches:
            return 0
        with fs.open_input_stream(max(batches, key=lambda f: int(f.base_name)).path) as f:
            return json.loads(f.read().decode().splitlines()[-1])["frame"]

    def initialOffset(self) -> dict:  # noqa: N802 - Spark's name
        return {"frame": 0}

    def latestOffset(self) -> dict:  # noqa: N802 - Spark's name
        end, planned = self._frames(), self._planned()
        return {"frame": max(planned, min(end, planned + self.batch) if self.checkpoint else end)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Part(f, start["frame"], end["frame"]) for f in self._files()] if start["frame"] < end["frame"] else []

    def read(self, partition: Any) -> Iterator[Any]:
        import pyarrow as pa
        import pyarrow.parquet as pq

        fs, _ = _filesystem(self.path)
        with fs.open_input_file(partition.file) as f:
            # few frames at a time and through a buffer: their detections are many times as large as they are
            for b in pq.ParquetFile(f, buffer_size=BUFFER, pre_buffer=False).iter_batches(BATCH, columns=["stream_id", "frame", "last", "detections"], use_threads=False):
                frame = b.column("frame").to_numpy(zero_copy_only=False)
                b = b.filter(pa.array((frame >= partition.start) & (frame < partition.end) & (frame % self.step == 0)))
                if b.num_rows:
                    yield self._rows(b)

    def _rows(self, b: Any) -> Any:
        """Frames as SCHEMA."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        final = -1 if self.most is None else (self.most - 1) // self.step * self.step
        frame, lists = b.column("frame").to_numpy(), b.column("detections")
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        each = np.maximum(counts, 1)  # a row without a detection for a frame that shows none
        of = pa.array(np.repeat(np.arange(len(frame)), each))
        at = pa.array(np.cumsum(np.repeat(counts > 0, each)) - 1, mask=np.repeat(counts == 0, each))
        shown = lists.flatten().take(at)
        last = np.where(frame == final, True, pc.fill_null(b.column("last"), False).to_numpy(zero_copy_only=False))
        heads = [b.column("stream_id"), b.column("frame"), pa.array(frame / self.fps), pa.array(last)]
        columns = [h.take(of) for h in heads] + [pc.struct_field(shown, c) for c in NAMES[4:]]
        return pa.RecordBatch.from_arrays(columns, names=NAMES)


class FrameSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: Any) -> DataSourceStreamReader:  # noqa: N802 - Spark's name
        return _Reader(dict(self.options))


def record(detections: DataFrame, frames: DataFrame, path: str) -> None:
    """Write detections of frames (stream_id, frame: all that there are) as a recording."""
    shown = detections.groupBy("stream_id", "frame").agg(F.array_sort(F.collect_list(F.struct("det_id", "class_id", "confidence", "x1", "y1", "x2", "y2"))).alias("detections"))
    ends = frames.groupBy("stream_id").agg(F.max("frame").alias("end"))
    rows = frames.select("stream_id", "frame").distinct().join(shown, ["stream_id", "frame"], "left").join(ends, "stream_id")
    rows.select("stream_id", "frame", (F.col("frame") == F.col("end")).alias("last"), F.coalesce("detections", F.array().cast(DETECTIONS)).cast(DETECTIONS).alias("detections")).write.parquet(path)


def read_frames(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    """A recording as a streaming DataFrame of SCHEMA; options as above."""
    spark.dataSource.register(FrameSource)
    reader = spark.readStream.format(FORMAT)
    for k, v in options.items():
        reader = reader.option(k, str(v).lower() if isinstance(v, bool) else str(v))
    return reader.load(path)
