"""The overlap tracker over a stream of frames, with its tracks in the state store.

State of a stream: `seen` (last frame, late rows, next number, timer, and the active tracks by column), one value, since each
frame changes each of its tracks. A micro-batch reads and writes it once; a track that ended goes from it and, in
track_ends(), comes out once with all that is known of it. Tracks still active come out when the
stream's last frame is there (rows with `last`), or when nothing came for `idle` seconds (a processing-time timer). Frames up
to the last one that a stream has seen are late: they are dropped and counted, since the tracker cannot go back;
late_frames() reads the counts from the state store. Checkpoints make the query restart where it ended.

All of it needs the RocksDB state store (session.SETTINGS)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skeinwork.operators.tracking import _IN, _TRACK, IOU, MAX_MISSED, TRACK, TRACKED, Tracker, track_frames

SEEN = "last_frame int, late_rows long, next_id int, timer long, " + ", ".join(f"active_{c.split()[0]} array<{c.split()[1]}>" for c in TRACK.split(", "))
ENDED = "stream_id long, " + TRACK
_KINDS = [{"int": "int32", "long": "int64", "double": "float64"}[c.split()[1]] for c in TRACK.split(", ")]


class _Handler(StatefulProcessor):
    """ends: give the tracks that ended, not the tracked detections."""

    def __init__(self, iou: float, max_missed: int, ends: bool, idle: float | None):
        self.iou, self.max_missed, self.ends, self.idle = iou, max_missed, ends, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", SEEN)

    def _state(self) -> tuple:
        """Last frame, late rows, next number, timer and the active tracks."""
        found = self.seen.get() or (-1, 0, 1, -1, *([] for _ in _TRACK))
        return *found[:4], list(zip(*found[4:], strict=True))

    def _keep(self, last_frame: int, late: int, next_id: int, deadline: int, tracks: list[tuple]) -> None:
        columns = zip(*tracks, strict=True) if tracks else ([] for _ in _TRACK)
        self.seen.update((last_frame, late, next_id, deadline, *(list(c) for c in columns)))

    def _ended(self, key: Any, rows: list[tuple]) -> Any:
        import pandas as pd

        columns = zip(*rows, strict=True) if rows else ([] for _ in _TRACK)
        return pd.DataFrame({"stream_id": [key[0]] * len(rows)} | {c: np.array(v, t) for c, t, v in zip(_TRACK, _KINDS, columns, strict=True)})

    def handleInputRows(self, key: Any, rows: Iterator, timerValues: Any) -> Iterator:  # noqa: N802, N803 - Spark's names
        import pandas as pd

        last_frame, late, next_id, deadline, tracks = self._state()
        parts = list(rows)
        came = {c: np.concatenate([p[c].to_numpy() for p in parts]) for c in [*_IN, "last"]}
        old = came["frame"] <= last_frame
        late += int((old & ~np.isnan(came["det_id"].astype(float))).sum())
        if not old.all():
            came = {c: v[~old] for c, v in came.items()}
            tracker = Tracker(tracks, next_id, self.iou, self.max_missed)
            out, ended = track_frames(tracker, came)
            tracks, last_frame, next_id = tracker.rows(), int(came["frame"].max()), tracker.next
            if bool(came["last"].any()):  # no frame follows
                ended, tracks = ended + tracks, []
            if ended if self.ends else len(out["frame"]):
                yield self._ended(key, ended) if self.ends else pd.DataFrame(out)
        if self.idle is not None:
            if deadline >= 0:
                self.handle.deleteTimer(deadline)
            deadline = timerValues.getCurrentProcessingTimeInMs() + int(1000 * self.idle)
            self.handle.registerTimer(deadline)
        self._keep(last_frame, late, next_id, deadline, tracks)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator:  # noqa: N802, N803 - Spark's names
        last_frame, late, next_id, _, left = self._state()
        self._keep(last_frame, late, next_id, -1, [])
        if self.ends:
            yield self._ended(key, left)

    def close(self) -> None:
        pass


def _stream(detections: DataFrame, schema: str, handler: _Handler) -> DataFrame:
    last = F.col("last") if "last" in detections.columns else F.lit(False)
    rows = detections.select(*_IN, F.coalesce(last, F.lit(False)).alias("last"))
    return rows.groupBy("stream_id").transformWithStateInPandas(handler, outputStructType=schema, outputMode="Append", timeMode="None" if handler.idle is None else "ProcessingTime")


def track_stream(detections: DataFrame, iou: float = IOU, max_missed: int = MAX_MISSED) -> DataFrame:
    """As operators.tracking.track, for a streaming DataFrame; rows without a det_id are processed frames that show nothing."""
    return _stream(detections, TRACKED, _Handler(iou, max_missed, False, None))


def track_ends(detections: DataFrame, iou: float = IOU, max_missed: int = MAX_MISSED, idle: float | None = None) -> DataFrame:
    """Each track once, when it ends: ENDED. idle: seconds without a row after which a stream's tracks have ended."""
    return _stream(detections, ENDED, _Handler(iou, max_missed, True, idle))


def run_available(found: DataFrame, out: str, checkpoint: str) -> None:
    """Write all that is there into Parquet, exactly once, and stop; run again for what comes later."""
    q = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def late_frames(spark: SparkSession, checkpoint: str) -> DataFrame:
    """stream_id, last_frame, late_rows of each stream that the query of a checkpoint has seen, from its state store."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "seen").load()
    return state.select(F.col("key.stream_id").alias("stream_id"), F.col("value.last_frame").alias("last_frame"), F.col("value.late_rows").alias("late_rows"))


def progress(query: Any) -> dict[str, float]:
    """Rows and rows a second of a running query's last batch."""
    last = query.lastProgress or {}
    return {"rows": last.get("numInputRows", 0), "rows_per_second": last.get("processedRowsPerSecond", 0.0)}
