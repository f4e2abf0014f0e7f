"""Objects through frames: the overlap tracker, track summaries, running votes, held detections.

A stream's rows are its detections and, for each processed frame that shows nothing, one row without a det_id: the tracker
must see such frames, as a track that isn't met in more than `max_missed` processed frames ends there."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.schema import classes
from skeinwork.session import checkpointed

IOU, MAX_MISSED, MIN_HITS = 0.3, 5, 3


BOX = ["x1", "y1", "x2", "y2"]
#: A track, as the state of a stream keeps it and as it is told when it ends; s0 to s2 are the confidences by class.
TRACK = "track_id int, x1 int, y1 int, x2 int, y2 int, missed int, hits long, first_frame int, last_frame int, best double, s0 double, s1 double, s2 double"
_TRACK = [c.split()[0] for c in TRACK.split(", ")]


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of the boxes of a with those of b, row by row, 0 where the union is empty."""
    both = np.clip(np.minimum(a[:, 2:], b[:, 2:]) - np.maximum(a[:, :2], b[:, :2]), 0, None).prod(-1)
    area = lambda x: np.clip(x[:, 2:] - x[:, :2], 0, None).prod(-1)
    union = area(a) + area(b) - both
    return np.divide(both, union, out=np.zeros(union.shape), where=union > 0)


#: Pairs of boxes whose overlaps are held at once.
PAIRS = 1 << 18


class Tracker:
    """The active tracks of a stream, in the order they started, and the next number.

    A frame's detections and the active tracks pair up by falling overlap; equal overlaps take the higher track, then the
    higher detection. A track without a pair misses the frame and ends with more than max_missed missed frames in a row; a
    detection without one starts a track.

    A track's box is its last detection's, so overlaps are those of detections at most max_missed + 1 frames apart: arrays
    tell them for many frames at once, and only the pairs that overlap enough are gone through one by one."""

    def __init__(self, rows: list[tuple] | None = None, next_id: int = 1, iou: float = IOU, max_missed: int = MAX_MISSED):
        if not 0 < iou <= 1:
            raise ValueError("iou must be above 0, and 1 at most")
        self.iou, self.max_missed, self.next = iou, max_missed, next_id
        self.active = [list(r) for r in sorted(rows or [])]

    def rows(self) -> list[tuple]:
        """Tracks as TRACK has them."""
        return [tuple(t) for t in self.active]

    def _pairs(self, at: np.ndarray, boxes: np.ndarray, old: int) -> Iterator[tuple[int, int, float]]:
        """Boxes from the old-th on with those before that overlap them enough and may be their track's last, in order of the
        former. at: the boxes' frames, rising."""
        first = np.searchsorted(at, at[old:] - self.max_missed - 1)
        counts = np.searchsorted(at, at[old:]) - first
        ends = np.cumsum(counts)
        k = 0
        while k < len(counts):
            before = int(ends[k - 1]) if k else 0
            m = max(k + 1, int(np.searchsorted(ends, before + PAIRS, "right")))
            later = np.repeat(np.arange(k, m), counts[k:m])
            earlier = np.arange(before, int(ends[m - 1])) + (first - ends + counts)[later]
            value = overlaps(boxes[earlier], boxes[old + later])
            enough = np.flatnonzero(value >= self.iou)
            yield from zip((old + later[enough]).tolist(), earlier[enough].tolist(), value[enough].tolist(), strict=True)
            k = m

    def run(self, n: int, place: np.ndarray, frame: np.ndarray, class_id: np.ndarray, confidence: np.ndarray, boxes: np.ndarray) -> tuple[list[int], list[int], list[tuple]]:
        """n processed frames with their detections, in order: their tracks' numbers, their classes by vote so far, the tracks
        that ended. place: by detection, which of the n frames it is in."""
        tracks = sorted(self.active, key=lambda t: -t[5])
        old = len(tracks)
        at = np.concatenate((np.array([-1 - t[5] for t in tracks], np.int64), place))
        whole = np.concatenate((np.array([t[1:5] for t in tracks], np.int64).reshape(-1, 4), boxes))
        of: list[Any] = [*tracks, *[None] * len(place)]  # by box its track
        tip = [True] * old + [False] * len(place)  # whether it is its track's last
        told, number, kind, score, box = at.tolist(), frame.tolist(), class_id.tolist(), confidence.tolist(), boxes.tolist()
        ids, voted = [0] * len(place), [0] * len(place)
        pairs = self._pairs(at, whole, old)
        pair = next(pairs, None)
        cuts = [*np.flatnonzero(np.diff(place, prepend=-1)).tolist(), len(place)]
        for a, b in itertools.pairwise(cuts):
            ways = []
            while pair is not None and pair[0] < old + b:
                if tip[pair[1]]:
                    ways.append((pair[2], of[pair[1]][0], pair[0], pair[1]))
                pair = next(pairs, None)
            for _, _, later, earlier in sorted(ways, reverse=True) if len(ways) > 1 else ways:
                if tip[earlier] and of[later] is None:
                    of[later], tip[earlier] = of[earlier], False
            for d in range(a, b):
                t = of[old + d]
                if t is None:
                    of[old + d] = t = [self.next, 0, 0, 0, 0, 0, 0, number[d], 0, 0.0, 0.0, 0.0, 0.0]
                    self.next += 1
                tip[old + d] = True
                t[1:5], t[8] = box[d], number[d]
                t[6] += 1
                t[9] = max(t[9], score[d])
                t[10 + kind[d]] += score[d]
                ids[d], voted[d] = t[0], 1 if t[11] > t[10] and t[11] >= t[12] else 2 if t[12] > t[10] and t[12] > t[11] else 0
        active, ended = [], []
        for t, last, where in zip(of, tip, told, strict=True):
            if last:
                t[5] = n - 1 - where
                if t[5] <= self.max_missed:
                    active.append(t)
                else:
                    t[5] = self.max_missed + 1
                    ended.append((where, tuple(t)))
        self.active = sorted(active)
        return ids, voted, [t for _, t in sorted(ended)]

    def update(self, frame: int, class_id: np.ndarray, confidence: np.ndarray, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
        """A processed frame's detections, as run() has them."""
        ids, voted, ended = self.run(1, np.zeros(len(boxes), np.int64), np.full(len(boxes), frame), class_id, confidence, boxes)
        return np.array(ids, np.int64), np.array(voted, np.int64), ended


TRACKED = "stream_id long, frame int, det_id long, class_id int, confidence double, x1 int, y1 int, x2 int, y2 int, track_id int, track_class_id int"
_IN = ["stream_id", "frame", "det_id", "class_id", "confidence", *BOX]
_TYPES = [c.split()[1] for c in TRACKED.split(", ")][: len(_IN)]


def track_frames(tracker: Tracker, rows: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], list[tuple]]:
    """A stream's rows (_IN as columns, in any order) through the tracker: the detections as TRACKED, the tracks that ended."""
    order = np.lexsort((rows["det_id"], rows["frame"]))
    rows = {c: rows[c][order] for c in _IN}
    place = np.cumsum(np.diff(rows["frame"], prepend=rows["frame"][:1]) != 0)
    real = ~np.isnan(rows["det_id"].astype(float))
    out = {c: v[real] for c, v in rows.items()}
    class_id, confidence, boxes = _plain(out)
    ids, voted, ended = tracker.run(int(place[-1]) + 1, place[real], out["frame"], class_id, confidence, boxes)
    whole = {c: out[c].astype(np.int64) for c in _IN if c != "confidence"}
    return out | whole | {"track_id": np.array(ids, np.int64), "track_class_id": np.array(voted, np.int64)}, ended


def _plain(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, confidence and box of detections; 0 for what they don't tell."""
    whole = lambda c: np.nan_to_num(rows[c]).astype(np.int64)
    return whole("class_id"), np.nan_to_num(rows["confidence"].astype(float)), np.stack([whole(c) for c in BOX], 1)


def with_empty_frames(detections: DataFrame, frames: DataFrame) -> DataFrame:
    """Detections, and a row without a detection for each processed frame (stream_id, frame) that shows none."""
    empty = frames.select("stream_id", "frame").distinct().join(detections, ["stream_id", "frame"], "left_anti")
    nothing = [F.lit(None).cast(detections.schema[c].dataType).alias(c) for c in _IN[2:]]
    return detections.select(*_IN).unionByName(empty.select("stream_id", "frame", *nothing))


def pieces(rows: DataFrame, step: int = 1, max_missed: int = MAX_MISSED) -> DataFrame:
    """Adds `piece`: rows of a stream up to a gap that ends every track, so that pieces can be tracked apart.

    A frame with detections starts a piece if none of the max_missed + 1 processed frames (multiples of `step`) before it
    has any. Frames meet only those of their own and the last window of so many, and starts are summed in two levels, so a
    stream is never one task."""
    gap = (max_missed + 1) * step
    shown = rows.where("det_id is not null").select("stream_id", "frame").distinct().withColumn("window", F.floor(F.col("frame") / gap))
    windows = shown.groupBy("stream_id", "window").agg(F.collect_set("frame").alias("own"))  # max_missed + 1 frames at most
    last = windows.select("stream_id", (F.col("window") + 1).alias("window"), F.col("own").alias("before"))
    met = windows.join(last, ["stream_id", "window"], "left").withColumn("all", F.concat("own", F.coalesce("before", F.array().cast("array<int>"))))
    starts = met.select("stream_id", F.explode(F.filter("own", lambda f: ~F.exists("all", lambda g: (g < f) & (g >= f - gap)))).alias("frame"))
    coarse = F.floor(F.col("frame") / (gap * COARSE)).alias("coarse")
    at = starts.select("stream_id", "frame", coarse)
    sums = at.groupBy("stream_id", "coarse").agg(F.count("*").alias("n"))
    # a row for each coarse window that holds a row of the stream, with the starts before it
    held = rows.select("stream_id", coarse).distinct().join(sums, ["stream_id", "coarse"], "left")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("stream_id").orderBy("coarse").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    here = at.groupBy("stream_id", "coarse").agg(F.array_sort(F.collect_list("frame")).alias("starts"))  # COARSE frames at most
    bounds = held.select("stream_id", "coarse", before.alias("before")).join(here, ["stream_id", "coarse"], "left")
    inside = F.coalesce(F.size(F.filter("starts", lambda f: f <= F.col("frame"))), F.lit(0))
    return rows.withColumn("coarse", coarse).join(bounds, ["stream_id", "coarse"]).withColumn("piece", F.col("before") + inside).drop("coarse", "before", "starts")


#: Windows of max_missed + 1 frames that are summed together.
COARSE = 1000


def track(detections: DataFrame, iou: float = IOU, max_missed: int = MAX_MISSED, frames: DataFrame | None = None, step: int = 1) -> DataFrame:
    """Detections with track_id and track_class_id.

    frames: the processed frames (stream_id, frame: multiples of `step`); without them those with a detection are all.
    With them a stream is cut where every track ends, its pieces are tracked in tasks of their own, and their numbers are
    shifted by the tracks of the pieces before: a long stream is one task only where it is never idle."""
    if frames is None:
        return _tracked(detections, ["stream_id"], iou, max_missed).drop("piece")
    whole = pieces(with_empty_frames(detections, frames), step, max_missed)
    found = checkpointed(_tracked(whole, ["stream_id", "piece"], iou, max_missed))
    tracks = found.groupBy("stream_id", "piece").agg(F.max("track_id").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("stream_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = tracks.select("stream_id", "piece", before.cast("int").alias("before"))  # a row per piece
    return found.join(shifts, ["stream_id", "piece"]).withColumn("track_id", F.col("track_id") + F.col("before")).drop("piece", "before")


def _tracked(rows: DataFrame, by: list[str], iou: float, max_missed: int) -> DataFrame:
    """Rows in the order of their pieces and frames, batch by batch through one tracker: between pieces it sees as many empty
    frames as end every track. It holds a batch, a frame and the active tracks, however long a piece is."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tracker, held, piece, base = Tracker(None, 1, iou, max_missed), None, None, 0
        for batch in itertools.chain(batches, [None]):
            table = pa.Table.from_batches([b for b in (held, batch) if b is not None]).combine_chunks() if held or batch else None
            if not table:
                continue
            key = np.stack([table.column(c).to_numpy() for c in ("stream_id", "piece", "frame")])
            n = table.num_rows
            if batch is not None:  # more of the last frame may come
                n = int(np.flatnonzero((key != key[:, -1:]).any(0))[-1]) + 1 if (key != key[:, -1:]).any() else 0
            held = table.slice(n).to_batches()[0] if n < table.num_rows else None
            if not n:
                continue
            key, real = key[:, :n], table.column("det_id").slice(0, n).is_valid().to_numpy(zero_copy_only=False)
            last = key[:2, :1] - 1 if piece is None else piece
            new = (np.diff(key[:2], axis=1, prepend=last) != 0).any(0)
            frames = new | (np.diff(key[2], prepend=key[2, 0] - 1) != 0)
            place = np.cumsum(frames + new * (max_missed + 1)) - 1
            found = table.slice(0, n).filter(pa.array(real))
            class_id, confidence, boxes = _plain({c: found.column(c).fill_null(0).to_numpy() for c in _IN[3:]})
            ids, voted, _ = tracker.run(int(place[-1]) + 1, place[real], key[2][real], class_id, confidence, boxes)
            # numbers go on from piece to piece: each piece's own start after those of the pieces before
            ids, own = np.array(ids, np.int64), np.cumsum(new)[real]
            starts = np.full(int(new.sum()) + 1, tracker.next - 1)
            np.minimum.at(starts, own, ids - 1)
            starts[0] = base
            piece, base = key[:2, -1:], int(starts[-1])
            out = [*(found.column(c) for c in _IN), pa.array((ids - starts[own]).astype(np.int32)), pa.array(np.array(voted, np.int32)), found.column("piece")]
            yield from pa.table(out, names=[*_IN, "track_id", "track_class_id", "piece"]).to_batches()

    rows = rows.select(*(F.col(c).cast(t) for c, t in zip(_IN, _TYPES, strict=True)), F.col("piece") if "piece" in by else F.lit(0).cast("long").alias("piece"))
    return rows.repartition(*by).sortWithinPartitions("stream_id", "piece", "frame", "det_id").mapInArrow(run, f"{TRACKED}, piece long")


def finished(tracked: DataFrame) -> DataFrame:
    """Tracks as the stream tells them at their ends: stream_id, track_id, hits, first_frame, last_frame, best, s0, s1, s2."""
    scores = [F.sum(F.when(F.col("class_id") == c, F.col("confidence")).otherwise(0.0)).alias(f"s{c}") for c in range(3)]
    return tracked.groupBy("stream_id", "track_id").agg(F.count("*").alias("hits"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.max("confidence").alias("best"), *scores)


def track_summary(tracked: DataFrame) -> DataFrame:
    """By track: hits, first and last frame, voted class (highest score, ties to the smaller id), confidences, vote shares.

    Two levels of plain sums: first by class, then over the classes of a track. conf_pct: confidence in hundredths."""
    by_class = tracked.groupBy("stream_id", "track_id", "class_id").agg(
        F.sum("conf_pct").alias("score"), F.count("*").alias("n"), F.min("frame").alias("first"), F.max("frame").alias("last"), F.max("conf_pct").alias("best")
    )
    d = by_class.groupBy("stream_id", "track_id").agg(
        F.sum("n").alias("hits"), F.min("first").alias("first_frame"), F.max("last").alias("last_frame"), F.sum("score").alias("total"), F.max("best").alias("best_pct"),
        F.max(F.struct("score", (-F.col("class_id")).alias("c"))).alias("vote"),
    )
    return d.select(
        "stream_id", "track_id", "hits", "first_frame", "last_frame", (-F.col("vote.c")).cast("int").alias("class_id"),
        (F.col("total") / F.col("hits")).alias("mean_pct"), "best_pct", (F.col("vote.score") / F.col("total")).alias("vote_share"),
    )


def confirmed(summary: DataFrame, min_hits: int = MIN_HITS) -> DataFrame:
    """Confirmed objects of each class, zero-filled, and how many tracks were too short."""
    n = summary.groupBy("class_id").agg(F.count_if(F.col("hits") >= min_hits).alias("objects"), F.count_if(F.col("hits") < min_hits).alias("unconfirmed"))
    d = classes(summary.sparkSession).join(n, "class_id", "left")
    return d.select("class_name", F.coalesce("objects", F.lit(0)).alias("objects"), F.coalesce("unconfirmed", F.lit(0)).alias("unconfirmed"))


def running_vote(tracked: DataFrame) -> DataFrame:
    """The class each track would have by each frame: classes not in the frame keep their sums."""
    w = Window.partitionBy("stream_id", "track_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    sums = [F.sum(F.when(F.col("class_id") == c, F.col("conf_pct")).otherwise(0)).over(w) for c in range(3)]
    best = F.greatest(*(F.struct(s.alias("s"), F.lit(-c).alias("c")) for c, s in enumerate(sums)))
    hits = F.count("*").over(w)
    return tracked.select("stream_id", "track_id", "frame", hits.alias("hits"), best.alias("v")).select("stream_id", "track_id", "frame", "hits", (-F.col("v.c")).alias("voted_class_id"))


def running_objects(tracked: DataFrame, min_hits: int = MIN_HITS) -> DataFrame:
    """Unique confirmed objects of a stream by each frame."""
    vote = running_vote(tracked)
    w = Window.partitionBy("stream_id").orderBy("frame").rangeBetween(Window.unboundedPreceding, 0)
    return vote.select("stream_id", "frame", F.sum(F.when(F.col("hits") == min_hits, 1).otherwise(0)).over(w).alias("objects")).distinct()


def sampled(frames: DataFrame, step: int) -> DataFrame:
    """Every step-th frame from 0."""
    if step < 1:
        raise ValueError("step must be at least 1")
    return frames.where(F.pmod("frame", F.lit(step)) == 0)


#: Fixed value: frames a second of a source that tells none.
FPS = 30.0


def seconds(frame, fps):
    """When a frame is shown, in seconds; a source without a frame rate over 0 counts as one of FPS."""
    return frame / F.coalesce(F.when(fps > 0, fps.cast("double")), F.lit(FPS))


def clip_rollup(frames: DataFrame) -> DataFrame:
    """split, n_clips, n_frames, n_objects, n_background. frames: split, clip, frame, objects (boxes in the frame).

    Clips first, then splits, each as a plain aggregate."""
    clips = frames.groupBy("split", "clip").agg(F.count("*").alias("frames"), F.sum("objects").alias("objects"), F.count_if(F.col("objects") == 0).alias("background"))
    return clips.groupBy("split").agg(F.count("*").alias("n_clips"), F.sum("frames").alias("n_frames"), F.sum("objects").alias("n_objects"), F.sum("background").alias("n_background"))


def held(frames: DataFrame, step: int, value: str) -> DataFrame:
    """Frames between processed ones show the last processed value (as-of, backward)."""
    w = Window.partitionBy("stream_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    shown = F.last(F.when(F.pmod("frame", F.lit(step)) == 0, F.col(value)), ignorenulls=True).over(w)
    return frames.select("stream_id", "frame", value, shown.alias("shown"))


def asof(left: DataFrame, right: DataFrame, by: str, on: str, values: list[str], width: int) -> DataFrame:
    """Rows of the left with `values` of the right's last row at or before them (by the column `on`); null without one. Of
    right rows at the same place the greatest values count.

    Places are cut into buckets of `width`. A bucket's rows meet in one window, and what comes from before is the last value
    of the buckets before, one row each: neither a long stream nor its rows are one window. With a width about the root of a
    stream's length both are short."""
    bucket = F.floor(F.col(on) / width).alias("__bucket")
    value = F.struct(*values).alias("__value")
    points = right.groupBy(by, on).agg(F.max(value).alias("__value")).withColumn("__bucket", bucket)
    ends = points.groupBy(by, "__bucket").agg(F.max_by("__value", on).alias("__end"))
    every = left.select(by, bucket).unionByName(points.select(by, "__bucket")).distinct().join(ends, [by, "__bucket"], "left")
    over = Window.partitionBy(by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select(by, "__bucket", F.last("__end", ignorenulls=True).over(over).alias("__carried"))
    rows = left.withColumn("__bucket", bucket).withColumn("__side", F.lit(1))
    both = rows.unionByName(points.withColumn("__side", F.lit(0)), allowMissingColumns=True)
    inside = Window.partitionBy(by, "__bucket").orderBy(on, "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__value", F.last("__value", ignorenulls=True).over(inside)).where("__side = 1").join(carried, [by, "__bucket"])
    kept = [c for c in left.columns if c not in values]
    return found.withColumn("__value", F.coalesce("__value", "__carried")).select(*kept, *(F.col(f"__value.{c}").alias(c) for c in values))


def positional(left: DataFrame, right: DataFrame, whole: bool = False) -> DataFrame:
    """Frames of a clip with the mask of the same number: all frames of the left, or only while both last."""
    return left.join(right, ["clip", "frame"], "inner" if whole else "left")


def detections_of(frames: DataFrame, model: Any, schema: str, least: float) -> DataFrame:
    """A model over batches of frames (a function of pandas frames); confidences below `least` go, unknown classes fail."""
    if not 0 <= least <= 1:
        raise ValueError("confidence must be within 0 and 1")

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            yield model(pdf)

    d = frames.mapInPandas(run, schema).where(F.col("confidence") >= least)
    known = F.when(F.col("class_id").isin(0, 1, 2), F.col("class_id")).otherwise(F.raise_error(F.concat(F.lit("unknown class "), F.col("class_id").cast("string"))).cast("int"))
    return d.withColumn("class_id", known)
