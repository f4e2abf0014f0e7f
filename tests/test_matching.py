from __future__ import annotations

import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinwork.operators import matching as m
from skeinwork.operators import tracking
from skeinwork.operators.tracking import Tracker

BOX = "frame_id long, box_id long, class_id int, x1 int, y1 int, x2 int, y2 int"
PRED = "frame_id long, pred_id long, class_id int, x1 int, y1 int, x2 int, y2 int"


def _iou(a, b):
    i = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    u = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i
    return i / u if u else 0.0


def _spec(gt, pred, threshold):
    """Counts by frame and class, by a plain loop over sorted candidates."""
    out = {}
    for key in {(g[0], g[2]) for g in gt} | {(p[0], p[2]) for p in pred}:
        g = sorted(x for x in gt if (x[0], x[2]) == key)
        p = sorted(x for x in pred if (x[0], x[2]) == key)
        c = sorted(((_iou(a[3:], b[3:]), i, j) for i, a in enumerate(g) for j, b in enumerate(p)), reverse=True)
        gs, ps = set(), set()
        for v, i, j in c:
            if v >= threshold and i not in gs and j not in ps:
                gs.add(i)
                ps.add(j)
        out[key] = (len(gs), len(p) - len(gs), len(g) - len(gs))
    return out


def test_greedy_matching_against_a_plain_loop(spark):
    rnd = random.Random(5)
    box = lambda: (lambda x, y: (x, y, x + rnd.choice((4, 8)), y + rnd.choice((4, 8))))(rnd.randrange(0, 12, 2), rnd.randrange(0, 12, 2))
    gt = [(rnd.randrange(6), i, rnd.randrange(2), *box()) for i in range(80)]
    pred = [(rnd.randrange(7), i, rnd.randrange(3), *box()) for i in range(90)]
    got = m.match_counts(spark.createDataFrame(gt, BOX), spark.createDataFrame(pred, PRED), 0.3).collect()
    assert {(r["frame_id"], r["class_id"]): (r["tp"], r["fp"], r["fn"]) for r in got} == _spec(gt, pred, 0.3)


def test_classes_are_not_matched_with_each_other(spark):
    gt = spark.createDataFrame([(1, 1, 0, 0, 0, 20, 20), (1, 2, 0, 30, 30, 40, 40)], BOX)
    pred = spark.createDataFrame([(1, 1, 0, 0, 0, 20, 20), (1, 2, 1, 0, 0, 20, 20)], PRED)
    got = {r["class_name"]: (r["tp"], r["fp"], r["fn"], r["precision"]) for r in m.totals(m.match_counts(gt, pred)).collect()}
    assert got == {"pothole": (1, 0, 1, 1.0), "crack": (0, 1, 0, 0.0), "manhole": (0, 0, 0, None)}


def test_named_confusions(spark):
    names = ["pothole", "crack", "manhole", "background"]
    counts = [[8, 0, 2, 1], [0, 5, 0, 1], [3, 0, 6, 1], [4, 7, 1, 0]]
    d = spark.createDataFrame([(names[i], names[j], n) for i, row in enumerate(counts) for j, n in enumerate(row)], "predicted string, actual string, n long")
    got = {(r["actual"], r["predicted"]): (r["count"], r["rate"]) for r in m.named_confusions(d).collect()}
    assert got[("pothole", "manhole")] == (3, 3 / 15)
    assert [got[k][0] for k in m.NAMED] == [3, 2, 7, 4]


def _update(t, frame, *detections):
    """One frame through the tracker: (class_id, confidence, box) each."""
    ids, voted, ended = t.update(frame, np.array([d[0] for d in detections], np.int64), np.array([d[1] for d in detections], float), np.array([d[2] for d in detections], np.int64).reshape(-1, 4))
    return list(zip(ids.tolist(), voted.tolist(), strict=True)), ended


def test_vote_of_a_flickering_track():
    t = Tracker(None, 1, 0.3, 2)
    seen = [_update(t, i, (c, 0.9, (i, 0, 20 + i, 20)))[0] for i, c in enumerate((0, 0, 2, 0))]
    assert seen == [[(1, 0)]] * 4
    assert t.rows() == [(1, 3, 0, 23, 20, 0, 4, 0, 3, 0.9, 0.9 + 0.9 + 0.9, 0.0, 0.9)]


def test_tracks_end_after_missed_updates():
    t = Tracker(None, 1, 0.3, 1)
    box = (0, 0, 10, 10)
    assert _update(t, 0, (0, 0.5, box)) == ([(1, 0)], [])
    assert _update(t, 1) == ([], [])
    assert _update(t, 2) == ([], [(1, 0, 0, 10, 10, 2, 1, 0, 0, 0.5, 0.5, 0.0, 0.0)])
    assert _update(t, 3, (0, 0.5, box)) == ([(2, 0)], [])
    with pytest.raises(ValueError, match="iou"):
        Tracker(None, 1, 0.0)


def test_equal_overlaps_take_the_higher_track():
    t = Tracker()
    _update(t, 0, (0, 0.5, (0, 0, 10, 10)), (1, 0.5, (0, 0, 10, 10)))
    assert _update(t, 1, (0, 0.5, (0, 0, 10, 10)))[0] == [(2, 0)]  # and equal votes the smaller class


DETECTION = "stream_id long, frame int, det_id long, class_id int, confidence double, x1 int, y1 int, x2 int, y2 int"


def _plain_tracks(detections, frames, iou=0.3, max_missed=5):
    """By stream and frame, one box after another: detections as TRACKED."""
    out = []
    for stream in sorted({f[0] for f in frames}):
        active, made = [], 0
        for frame in sorted(f[1] for f in frames if f[0] == stream):
            here = sorted(d for d in detections if d[:2] == (stream, frame))
            ways = sorted(((_iou(a["box"], d[5:]), i, j) for i, a in enumerate(active) for j, d in enumerate(here)), reverse=True)
            of = {}
            for value, i, j in ways:
                if value >= iou and j not in of and i not in of.values():
                    of[j] = i
            met = {id(active[i]) for i in of.values()}
            for j, d in enumerate(here):
                if j not in of:
                    made += 1
                    active.append({"id": made, "missed": 0, "votes": [0.0] * 3})
                    of[j] = len(active) - 1
                a = active[of[j]]
                met.add(id(a))
                a["box"], a["missed"] = d[5:], 0
                a["votes"][d[3]] += d[4]
            for j, d in enumerate(here):
                votes = active[of[j]]["votes"]
                out.append((*d, active[of[j]]["id"], votes.index(max(votes))))
            for a in active:
                a["missed"] += id(a) not in met
            active = [a for a in active if a["missed"] <= max_missed]
    return sorted(out)


def _moving(seed, n=2, length=160, gaps=(5, 6, 7)):
    """Streams of a few moving boxes, dark for as many frames as a track may miss, one more and two more."""
    rnd, rows, k = random.Random(seed), [], 0
    dark = {f for i, g in enumerate(gaps) for f in range(20 + 40 * i, 20 + 40 * i + g)}
    for stream in range(n):
        for frame in range(length):
            for o in range(3):
                if frame not in dark and rnd.random() < 0.8:
                    x, y = 10 + 30 * o + frame % 7, 10 + rnd.randrange(4)
                    rows.append((stream, frame, k, rnd.choice((0, 0, 1, 2)), rnd.randrange(1, 9) / 8, x, y, x + 20, y + 20))
                    k += 1
    return rows, [(s, f) for s in range(n) for f in range(length)]


def test_plain_loop_and_pieces_agree(spark, monkeypatch):
    monkeypatch.setattr(tracking, "COARSE", 2)
    rows, frames = _moving(3)
    d, f = spark.createDataFrame(rows, DETECTION), spark.createDataFrame(frames, "stream_id long, frame int")
    want = _plain_tracks(rows, frames)
    got = sorted(map(tuple, tracking.track(d, frames=f).collect()))
    assert got == want
    cut = tracking.pieces(tracking.with_empty_frames(d, f))
    assert cut.where("det_id is not null").groupBy("stream_id").agg(F.count_distinct("piece").alias("n")).first()["n"] >= 3
    assert want != _plain_tracks(rows, [(r[0], r[1]) for r in rows])  # empty frames tell
    assert sorted(map(tuple, tracking.track(d).collect())) == _plain_tracks(rows, list({(r[0], r[1]) for r in rows}))


def test_pieces_of_every_third_frame(spark):
    rows, _ = _moving(5, n=1)
    rows = [r for r in rows if r[1] % 3 == 0 and not 60 <= r[1] < 60 + 18]
    frames = [(0, f) for f in range(0, 160, 3)]
    d, f = spark.createDataFrame(rows, DETECTION), spark.createDataFrame(frames, "stream_id long, frame int")
    assert sorted(map(tuple, tracking.track(d, frames=f, step=3).collect())) == _plain_tracks(rows, frames)
    assert tracking.pieces(tracking.with_empty_frames(d, f), 3).where("det_id is not null").select("piece").distinct().count() == 2
    assert tracking.track(d.where("false"), frames=f).collect() == []


def test_registered_trackers_against_the_plain_loop(spark, small):
    from skeinwork.plans import registry, views

    detections = [tuple(r) for r in views.frame_detections(spark, small).collect()]
    want = _plain_tracks(detections, [tuple(r) for r in views.processed_frames(spark, small).collect()])
    q = registry.queries()
    assert sorted(map(tuple, q["iou_tracker_batch"](spark, small).collect())) == want
    assert sorted(map(tuple, q["iou_tracker_stream"](spark, small).collect())) == want
    gt = [tuple(r) for r in views.gt_boxes(spark, small).select("frame_id", "box_id", "class_id", "x1", "y1", "x2", "y2").collect()]
    hits = Counter((r[0], r[9]) for r in want)
    names = {0: "pothole", 1: "crack", 2: "manhole"}
    scores = {}
    for way in ("raw", "voted", "kept"):
        pred = [(r[0] * 100 + r[1], r[2], r[3] if way == "raw" else r[10], *r[5:9]) for r in want if way != "kept" or hits[r[0], r[9]] >= 2]
        for (_, c), counts in _spec(gt, pred, 0.5).items():
            scores[way, names[c]] = [a + b for a, b in zip(scores.get((way, names[c]), [0, 0, 0]), counts, strict=True)]
    got = {(r["way"], r["class_name"]): [r["tp"], r["fp"], r["fn"]] for r in q["tracker_kept_counts"](spark, small).collect()}
    assert got == scores
    ends = sorted(map(tuple, q["finished_tracks_stream"](spark, small).collect()))
    assert ends == sorted(map(tuple, q["finished_tracks_batch"](spark, small).collect()))
    assert len(ends) == len(hits)


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    from skeinwork.streaming.tracker import late_frames, run_available, track_stream

    rows, frames = _moving(7)
    d = tracking.with_empty_frames(spark.createDataFrame(rows, DETECTION), spark.createDataFrame(frames, "stream_id long, frame int")).cache()
    where = [str(tmp_path / x) for x in ("in", "out", "checkpoint")]
    for part in (d.where("frame < 40"), d.where("frame >= 40"), d.where("frame = 3 or (frame = 4 and stream_id = 1)")):  # the last come too late
        part.write.mode("append").parquet(where[0])
        run_available(track_stream(spark.readStream.schema(d.schema).parquet(where[0])), where[1], where[2])
    assert sorted(map(tuple, spark.read.parquet(where[1]).collect())) == _plain_tracks(rows, frames)
    late = {s: sum(r[0] == s and (r[1] == 3 or (r[1] == 4 and s == 1)) for r in rows) for s in (0, 1)}
    assert {r["stream_id"]: (r["last_frame"], r["late_rows"]) for r in late_frames(spark, where[2]).collect()} == {s: (159, n) for s, n in late.items()}


def test_idle_streams_end_by_a_timer(spark, tmp_path):
    from skeinwork.streaming.tracker import run_available, track_ends

    rows, frames = _moving(9, n=1, length=30, gaps=())
    d = spark.createDataFrame(rows, DETECTION)
    where = [str(tmp_path / x) for x in ("in", "out", "checkpoint")]
    d.write.parquet(where[0])
    stream = lambda: track_ends(spark.readStream.schema(d.schema).parquet(where[0]), idle=1.0)
    q = stream().writeStream.format("parquet").option("path", where[1]).option("checkpointLocation", where[2]).start()
    try:
        deadline = time.time() + 60
        while time.time() < deadline and spark.read.schema("hits long").parquet(where[1]).agg(F.sum("hits")).first()[0] != len(rows):
            time.sleep(0.5)
    finally:
        q.stop()
    want = _plain_tracks(rows, list({(r[0], r[1]) for r in rows}))
    got = sorted((r["track_id"], r["hits"], r["first_frame"], r["last_frame"]) for r in spark.read.parquet(where[1]).collect())
    by = {i: [r for r in want if r[9] == i] for i in {r[9] for r in want}}
    assert got == sorted((i, len(x), x[0][1], x[-1][1]) for i, x in by.items())
    assert run_available  # the other way to run it


@pytest.mark.parametrize(("options", "end"), [({}, 160), ({"maxFrames": 90}, 90), ({"maxFrames": 90, "step": 4}, 90), ({"maxFrames": 300, "live": True}, 160)])
def test_frames_are_read_once_to_each_end(spark, tmp_path, options, end):
    from skeinwork.sources.frames import read_frames, record
    from skeinwork.streaming.tracker import run_available

    rows, frames = _moving(2)
    where = [str(tmp_path / x) for x in ("in", "out", "checkpoint")]
    record(spark.createDataFrame(rows, DETECTION), spark.createDataFrame(frames, "stream_id long, frame int"), where[0])
    for most in (20, end):  # the second query starts again from the first one's checkpoint
        how = options | ({"maxFrames": most} if most == 20 or "maxFrames" in options else {})
        run_available(read_frames(spark, where[0], framesPerBatch=35, checkpoint=where[2], fps=0, **how), where[1], where[2])
    step, last = options.get("step", 1), min(end, 160)
    got = spark.read.parquet(where[1]).collect()
    want = {(s, f) for s, f in frames if f < last and f % step == 0}
    assert {(r["stream_id"], r["frame"]) for r in got} == want
    assert sorted(r["det_id"] for r in got if r["det_id"] is not None) == [r[2] for r in rows if r[1] < last and r[1] % step == 0]
    assert all(r["seconds"] == r["frame"] / 30 for r in got)
    assert {(r["stream_id"], r["frame"]) for r in got if r["last"]} >= {(s, (last - 1) // step * step) for s in (0, 1)}
    n_batches = sum(f.name.isdigit() for f in (tmp_path / "checkpoint" / "offsets").iterdir())
    assert n_batches >= 1 + (last - 20) // 35


def test_live_sources_need_a_limit(spark, tmp_path):
    from skeinwork.sources.frames import _Reader

    with pytest.raises(ValueError, match="maxFrames"):
        _Reader({"path": str(tmp_path), "live": "true"})
    with pytest.raises(ValueError, match="step"):
        _Reader({"path": str(tmp_path), "step": "0"})


def test_frames_are_read_few_at_a_time(spark, tmp_path, monkeypatch):
    import pyarrow as pa

    from skeinwork.sources import frames as source

    rows, frames = _moving(4)
    source.record(spark.createDataFrame(rows, DETECTION), spark.createDataFrame(frames, "stream_id long, frame int"), str(tmp_path / "in"))
    monkeypatch.setattr(source, "BATCH", 8, raising=False)
    reader = source._Reader({"path": str(tmp_path / "in"), "step": "3"})
    got = [b for part in reader.partitions({"frame": 30}, {"frame": 120}) for b in reader.read(part)]
    assert got and all(isinstance(b, pa.RecordBatch) and b.schema.names == source.NAMES for b in got)
    assert max(len(set(zip(b["stream_id"].to_pylist(), b["frame"].to_pylist(), strict=True))) for b in got) <= 8
    told = [tuple(r[c] for c in ("stream_id", "frame", "det_id", "class_id", "confidence", "x1", "y1", "x2", "y2")) for b in got for r in b.to_pylist()]
    shown = [r for r in rows if 30 <= r[1] < 120 and r[1] % 3 == 0]
    dark = {f for f in frames if 30 <= f[1] < 120 and f[1] % 3 == 0} - {r[:2] for r in shown}
    assert dark
    assert sorted(r for r in told if r[2] is not None) == sorted(shown)
    assert sorted(r for r in told if r[2] is None) == sorted((*f, *[None] * 7) for f in dark)


def test_many_frames_at_once_as_one_by_one(monkeypatch):
    rnd = random.Random(11)
    for size, most in ((4, 1 << 18), (12, 7), (40, 50)):
        monkeypatch.setattr(tracking, "PAIRS", most, raising=False)
        frames = [[(rnd.randrange(3), rnd.randrange(1, 4) / 4, (lambda x, y: (x, y, x + rnd.choice((0, 4, 8)), y + 4))(rnd.randrange(0, size, 2), rnd.randrange(0, 8, 2))) for _ in range(rnd.choice((0, 0, 1, 5)))] for _ in range(90)]
        rows = [(0, f, 100 * f + i, c, p, *b) for f, found in enumerate(frames) for i, (c, p, b) in enumerate(found)]
        want = [r[-2:] for r in _plain_tracks(rows, [(0, f) for f in range(90)], max_missed=2)]
        apart, whole = Tracker(None, 1, 0.3, 2), Tracker(None, 1, 0.3, 2)
        one, over = [], []
        for f, found in enumerate(frames):
            seen, ended = _update(apart, f, *found)
            one += seen
            over += ended
        got, ends = [], []
        for a, b in ((0, 31), (31, 32), (32, 90)):  # tracks go on from call to call
            part = [r for r in rows if a <= r[1] < b]
            column = lambda k, t=np.int64, part=part: np.array([r[k] for r in part], t)
            ids, voted, ended = whole.run(b - a, column(1) - a, column(1), column(3), column(4, float), np.array([r[5:] for r in part], np.int64).reshape(-1, 4))
            got += zip(ids, voted, strict=True)
            ends += ended
        assert got == one == want
        assert ends == over
        assert whole.rows() == apart.rows()


def test_the_state_of_a_stream_is_one_value(spark, tmp_path):
    from skeinwork.streaming.tracker import run_available, track_stream

    rows, _ = _moving(7, n=1, length=20, gaps=())
    d = spark.createDataFrame(rows, DETECTION)
    where = [str(tmp_path / x) for x in ("in", "out", "checkpoint")]
    d.write.parquet(where[0])
    run_available(track_stream(spark.readStream.schema(d.schema).parquet(where[0])), where[1], where[2])
    seen = spark.read.format("statestore").option("path", where[2]).option("stateVarName", "seen").load().select("value.*").collect()
    want = _plain_tracks(rows, list({r[:2] for r in rows}))
    last = {i: max(r for r in want if r[9] == i) for i in {r[9] for r in want}}
    active = {i: r for i, r in last.items() if r[1] >= 14}
    assert [r["active_track_id"] for r in seen] == [sorted(active)]
    assert seen[0]["active_x1"] == [active[i][5] for i in sorted(active)]


def test_late_frames_are_not_written_by_one_task(spark, small, monkeypatch):
    from skeinwork.plans import registry

    def coalesce(self, n):
        raise AssertionError(f"{n} tasks")

    monkeypatch.setattr(type(spark.range(1)), "coalesce", coalesce)
    assert registry.queries()["late_frame_counts"](spark, small).count() > 0


def test_pieces_go_on_from_batch_to_batch(spark):
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    rows, frames = _moving(13, n=3, length=90)
    rows = [r for r in rows if r[0] != 1 or r[1] > 30]  # a stream that begins with nothing
    d, f = spark.createDataFrame(rows, DETECTION), spark.createDataFrame(frames, "stream_id long, frame int")
    try:
        for n in (1, 4, 10000):
            spark.conf.set(size, n)
            found = tracking.track(d, frames=f)
            assert sorted(map(tuple, found.collect())) == _plain_tracks(rows, frames)
        alone = tracking.track(d)
        assert sorted(map(tuple, alone.collect())) == _plain_tracks(rows, list({r[:2] for r in rows}))
        assert "InPandas" not in alone._jdf.queryExecution().toString()  # no piece is one Python group
    finally:
        spark.conf.set(size, before)
