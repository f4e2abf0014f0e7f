"""Queries of frames and tracks."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import functions as F

from skeinwork.operators import masks
from skeinwork.operators import tracking as t
from skeinwork.plans import views as v
from skeinwork.plans.views import sql
from skeinwork.session import checkpointed, shared_dir
from skeinwork.sources.frames import read_frames, record
from skeinwork.streaming.tracker import late_frames, run_available, track_ends, track_stream


def track_summary(s, d):
    return t.track_summary(v.frames(s, d))


def confirmed_tracks(s, d):
    return t.confirmed(track_summary(s, d), 15)


def running_vote(s, d):
    return t.running_vote(v.frames(s, d))


def running_objects(s, d):
    return t.running_objects(v.frames(s, d))


def hold_last(s, d):
    return t.held(v.frames(s, d), 5, "conf_pct")


def held_detections(s, d):
    """Every frame of a stream with the last purchase or signup that its stream showed up to it."""
    f = v.frames(s, d)
    return t.asof(f.select("stream_id", "frame", "det_id"), f.where("class_id = 1").select("stream_id", "frame", "track_id", "conf_pct"), "stream_id", "frame", ["track_id", "conf_pct"], 16)


def frame_step_sample(s, d):
    return t.sampled(v.frames(s, d), 12).select("stream_id", "frame", "det_id")


def frame_seconds(s, d):
    """Frames of streams at 25 frames a second; every fifth stream tells no frame rate."""
    fps = F.when(F.col("stream_id") % 5 == 0, 0).otherwise(25)
    return v.frames(s, d).select("stream_id", "frame", "det_id", t.seconds(F.col("frame"), fps).alias("seconds"))


def clip_rollup(s, d):
    """Streams as clips, three splits by number; frames whose confidence ends in 0 show nothing."""
    f = v.frames(s, d)
    split = F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (F.pmod("stream_id", F.lit(3)) + 1).cast("int"))
    return t.clip_rollup(f.select(split.alias("split"), F.col("stream_id").alias("clip"), "frame", F.pmod("conf_pct", F.lit(10)).alias("objects")))


def iou_tracker_batch(s, d):
    return t.track(v.frame_detections(s, d), frames=v.processed_frames(s, d))


@contextmanager
def _rocksdb(s):
    """A session of its own with the state store that the stream needs; the caller's settings stay."""
    own = s.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    shared_dir(s)
    yield own, f"{shared_dir(s).rstrip('/')}/stream-{uuid.uuid4().hex}"


def iou_tracker_stream(s, d):
    """The same frames from a recording through the stateful stream, a hundred frames of each stream in three micro-batches."""
    with _rocksdb(s) as (own, here):
        record(v.frame_detections(own, d), v.processed_frames(own, d), f"{here}/in")
        frames = read_frames(own, f"{here}/in", framesPerBatch=40, checkpoint=f"{here}/checkpoint")
        run_available(track_stream(frames), f"{here}/out", f"{here}/checkpoint")
    return s.read.parquet(f"{here}/out")


def finished_tracks_batch(s, d):
    """Tracks with what is known of them at their ends, from the tracked detections."""
    return t.finished(iou_tracker_batch(s, d)).drop("best", "s0", "s1", "s2")


def finished_tracks_stream(s, d):
    """The same from the stream, each when it ends; the query is stopped half-way and started again."""
    with _rocksdb(s) as (own, here):
        record(v.frame_detections(own, d), v.processed_frames(own, d), f"{here}/in")
        for most in (45, None):  # the second reader goes on where the offsets of the first end
            limit = {"maxFrames": most} if most else {}
            frames = read_frames(own, f"{here}/in", framesPerBatch=40, checkpoint=f"{here}/checkpoint", **limit)
            frames = frames.withColumn("last", F.lit(False)) if most else frames
            run_available(track_ends(frames), f"{here}/out", f"{here}/checkpoint")
    return s.read.parquet(f"{here}/out").select("stream_id", "track_id", "hits", "first_frame", "last_frame")


def late_frame_counts(s, d):
    """Detections of frames that came after later ones: the second half of all frames first, then the first."""
    with _rocksdb(s) as (own, here):
        frames = v.frame_detections(own, d)
        for k, part in enumerate((frames.where("frame >= 50"), frames.where("frame < 50"))):
            part.write.mode("append").parquet(f"{here}/in")
            stream = own.readStream.schema(frames.schema).parquet(f"{here}/in")
            run_available(track_stream(stream), f"{here}/out", f"{here}/checkpoint")
        return late_frames(s, f"{here}/checkpoint")


def tracker_kept_counts(s, d):
    """Matches by the class of each frame, by voted class, and by that of only those detections whose track has two hits."""
    from skeinwork.operators.matching import scored_ways, totals_by_way

    tracked = iou_tracker_batch(s, d).withColumn("frame_id", F.col("stream_id") * 100 + F.col("frame")).withColumnRenamed("det_id", "pred_id")
    return totals_by_way(scored_ways(v.gt_boxes(s, d), checkpointed(tracked), 2))


def _masks(s, d):
    """Ground truth drawn into masks of 80 by 80: a row of pixels each, 200 where a box of the frame covers the pixel."""
    import numpy as np
    import pyarrow as pa

    cell, side, some = 8, 80, 256  # so many masks of a batch

    def draw(batches):
        for batch in batches:
            for k in range(0, len(batch), some):
                frames, lists = batch.column("frame_id").slice(k, some), batch.column("boxes").slice(k, some)
                boxes = lists.flatten()
                x1, y1, x2, y2 = (np.clip(boxes.field(c).to_numpy(), 0, side).tolist() for c in range(4))
                of = np.repeat(np.arange(len(frames)), np.diff(lists.offsets.to_numpy())).tolist()
                grey = np.zeros((len(frames), side, side), np.int32)
                for i, a, b, c, e in zip(of, x1, y1, x2, y2, strict=True):
                    grey[i, b:e, a:c] = 200
                rows = pa.ListArray.from_arrays(pa.array(np.arange(0, grey.size + 1, side, dtype=np.int32)), pa.array(grey.ravel()))
                yield pa.RecordBatch.from_arrays([frames.take(pa.array(np.repeat(np.arange(len(frames)), side))), pa.array(np.tile(np.arange(side, dtype=np.int32), len(frames))), rows], ["mask_id", "y", "grey"])

    boxes = v.gt_boxes(s, d).select("frame_id", F.struct(*(F.floor(F.col(c) / cell).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2"))).alias("b")).groupBy("frame_id").agg(F.collect_list("b").alias("boxes"))
    return boxes.mapInArrow(draw, "mask_id long, y int, grey array<int>")


def mask_boxes(s, d):
    return masks.mask_boxes(_masks(s, d), 127, 30)


def masks_by_place(s, d):
    """Frames with the confidence of the mask of their number, where there is one: clips are streams, masks those of track 1."""
    f = v.frames(s, d)
    clips = f.select(F.col("stream_id").alias("clip"), "frame", "det_id")
    return t.positional(clips, f.where("track_id = 1").select(F.col("stream_id").alias("clip"), "frame", F.col("conf_pct").alias("mask")))


def model_detections(s, d):
    """A model that sees a class in a frame's number; those it is less than 40 per cent sure of go."""

    def model(pdf):
        return pdf.assign(class_id=(pdf["det_id"] % 3).astype("int32"), confidence=pdf["conf_pct"] / 100)[["stream_id", "frame", "det_id", "class_id", "confidence"]]

    return t.detections_of(v.frames(s, d).select("stream_id", "frame", "det_id", "conf_pct"), model, "stream_id long, frame int, det_id long, class_id int, confidence double", 0.4)


_VOTES = "sums AS (SELECT stream_id, track_id, frame, " + ", ".join(f"sum(CASE WHEN class_id = {c} THEN conf_pct ELSE 0 END) OVER w AS s{c}" for c in range(3)) + ", count(*) OVER w AS hits FROM frames WINDOW w AS (PARTITION BY stream_id, track_id ORDER BY frame ROWS UNBOUNDED PRECEDING))"
_TRACKS = """byc AS (SELECT stream_id, track_id, class_id, sum(conf_pct) AS score, count(*) AS n, min(frame) AS f, max(frame) AS l, max(conf_pct) AS b FROM frames GROUP BY ALL),
tr AS (SELECT stream_id, track_id, sum(n)::BIGINT AS hits, min(f) AS first_frame, max(l) AS last_frame, CAST(first(class_id ORDER BY score DESC, class_id) AS INT) AS class_id,
 sum(score) / sum(n)::DOUBLE AS mean_pct, max(b) AS best_pct, max(score) / sum(score)::DOUBLE AS vote_share FROM byc GROUP BY ALL)"""

QUERIES = {
    "track_summary": (track_summary, sql("SELECT * FROM tr", "frames", extra=_TRACKS)),
    "confirmed_tracks": (confirmed_tracks, sql("SELECT class_name, coalesce(count_if(hits >= 15), 0)::BIGINT AS objects, coalesce(count_if(hits < 15), 0)::BIGINT AS unconfirmed FROM classes LEFT JOIN tr USING (class_id) GROUP BY class_name", "frames", "classes", extra=_TRACKS)),
    "running_vote": (running_vote, sql("SELECT stream_id, track_id, frame, hits, CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS voted_class_id FROM sums", "frames", extra=_VOTES)),
    "running_objects": (running_objects, sql("SELECT DISTINCT stream_id, frame, (sum(CASE WHEN hits = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY frame))::BIGINT AS objects FROM sums", "frames", extra=_VOTES)),
    "hold_last": (hold_last, sql("SELECT stream_id, frame, conf_pct, last_value(CASE WHEN frame % 5 = 0 THEN conf_pct END IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS shown FROM frames", "frames")),
    "held_detections": (held_detections, sql("SELECT a.stream_id, a.frame, a.det_id, b.track_id, b.conf_pct FROM frames a ASOF LEFT JOIN (SELECT stream_id, frame, track_id, conf_pct FROM frames WHERE class_id = 1) b ON a.stream_id = b.stream_id AND a.frame >= b.frame", "frames")),
    "mask_boxes": (mask_boxes, None),
    "masks_by_place": (masks_by_place, sql("SELECT f.stream_id AS clip, f.frame, f.det_id, m.conf_pct AS mask FROM frames f LEFT JOIN (SELECT * FROM frames WHERE track_id = 1) m ON f.stream_id = m.stream_id AND f.frame = m.frame", "frames")),
    "model_detections": (model_detections, sql("SELECT stream_id, frame, det_id, CAST(det_id % 3 AS INT) AS class_id, conf_pct / 100.0::DOUBLE AS confidence FROM frames WHERE conf_pct >= 40", "frames")),
    "frame_step_sample": (frame_step_sample, sql("SELECT stream_id, frame, det_id FROM frames WHERE frame % 12 = 0", "frames")),
    "frame_seconds": (frame_seconds, sql("SELECT stream_id, frame, det_id, frame / CASE WHEN stream_id % 5 <> 0 THEN 25.0::DOUBLE ELSE 30.0::DOUBLE END AS seconds FROM frames", "frames")),
    "clip_rollup": (clip_rollup, sql("""SELECT split, count(DISTINCT stream_id) AS n_clips, count(*) AS n_frames, sum(objects)::BIGINT AS n_objects, count_if(objects = 0)::BIGINT AS n_background FROM (
 SELECT stream_id, conf_pct % 10 AS objects, CASE stream_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM frames) GROUP BY split""", "frames")),
    "iou_tracker_batch": (iou_tracker_batch, None),
    "iou_tracker_stream": (iou_tracker_stream, None),
    "finished_tracks_batch": (finished_tracks_batch, None),
    "finished_tracks_stream": (finished_tracks_stream, None),
    "late_frame_counts": (late_frame_counts, sql("SELECT stream_id, max(frame) AS last_frame, CASE WHEN max(frame) >= 50 THEN count_if(frame < 50) ELSE 0 END AS late_rows FROM (SELECT frame_id // 100 AS stream_id, CAST(frame_id % 100 AS INT) AS frame FROM pred) WHERE frame % 20 >= 4 + stream_id % 6 GROUP BY stream_id", "pred")),
    "tracker_kept_counts": (tracker_kept_counts, None),
}
