"""Queries of boxes: geometry, statistics, matching, confusions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from skeinwork.functions import geometry as g
from skeinwork.functions.annotations import canonical
from skeinwork.operators import matching as m
from skeinwork.operators import precision
from skeinwork.operators import sampling, stats
from skeinwork.plans import views as v
from skeinwork.plans.views import SIDE, sql, table

_XYWH = ("xc", "yc", "w", "h")
DX, DY, SCALE, ANGLE, TARGET = 0.03, -0.02, 1.1, 7.0, (512, 320)


def _cols():
    return [F.col(c) for c in _XYWH]


def boxes_to_pixels(s, d):
    return v.normalised(s, d).select("frame_id", "box_id", g.to_pixels(*_cols(), 600, 450).alias("b")).select("frame_id", "box_id", "b.*")


def pixels_to_boxes(s, d):
    return v.gt_boxes(s, d).select("box_id", g.to_label(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), SIDE, SIDE).alias("b")).select("box_id", "b.*")


def canonical_labels(s, d):
    return v.normalised(s, d).select("box_id", canonical(*_cols()).alias("b")).select("box_id", "b.*")


def boxes_rescaled(s, d):
    return v.gt_boxes(s, d).select("box_id", g.rescaled(F.col("x1"), 640, 416).alias("x1"), g.rescaled(F.col("y1"), 640, 320).alias("y1"), g.rescaled(F.col("x2"), 640, 416).alias("x2"), g.rescaled(F.col("y2"), 640, 320).alias("y2"))


def _moved(s, d, box):
    return v.normalised(s, d).select("box_id", box.alias("b")).where("b is not null").select("box_id", "b.*")


def letterbox_boxes(s, d):
    return _moved(s, d, g.letterbox(*_cols(), (640, 640), TARGET))


def flip_boxes(s, d):
    return _moved(s, d, g.flipped(*_cols()))


def translate_boxes(s, d):
    return _moved(s, d, g.translated(*_cols(), DX, DY))


def scale_boxes(s, d):
    return _moved(s, d, g.scaled(*_cols(), SCALE))


def rotate_boxes(s, d):
    return _moved(s, d, g.rotated(*_cols(), ANGLE, SIDE, SIDE))


def pixel_box_problems(s, d):
    """Boxes that are no ground truth on an image of 24 by 18 pixels."""
    box = g.to_pixels(*_cols(), 24, 18)
    return v.normalised(s, d).select("frame_id", "box_id", box.alias("b"), g.pixel_problem(box).alias("problem")).where("problem is not null").select("frame_id", "box_id", "b.*", "problem")


def in_frame_boxes(s, d):
    """Boxes moved without a cut, and what the last filter leaves of them."""
    return v.normalised(s, d).withColumn("xc", F.col("xc") + F.lit(DX)).where(g.in_frame(*_cols(), F.col("class_id"))).select("box_id", *_XYWH)


def _cut(l, t, r, b, least):  # noqa: E741
    one = lambda x: f"greatest(0, least(1, {x}))"
    return f"""SELECT box_id, (l + r) / 2 AS xc, (t + b) / 2 AS yc, r - l AS w, b - t AS h FROM (
 SELECT box_id, {one(l)} AS l, {one(t)} AS t, {one(r)} AS r, {one(b)} AS b FROM norm) WHERE r - l > {least} AND b - t > {least}"""


def _around(x, y, w, h, least):
    return _cut(f"({x}) - ({w}) / 2", f"({y}) - ({h}) / 2", f"({x}) + ({w}) / 2", f"({y}) + ({h}) / 2", least)


_R = min(TARGET[0] / 640, TARGET[1] / 640)
_DW, _DH = (TARGET[0] - round(640 * _R)) / 2, (TARGET[1] - round(640 * _R)) / 2
_D = lambda x: f"{x!r}::DOUBLE"
_LETTERBOX = _around(
    f"(xc * 640.0::DOUBLE * {_D(_R)} + {_D(_DW)}) / {_D(float(TARGET[0]))}", f"(yc * 640.0::DOUBLE * {_D(_R)} + {_D(_DH)}) / {_D(float(TARGET[1]))}",
    f"w * 640.0::DOUBLE * {_D(_R)} / {_D(float(TARGET[0]))}", f"h * 640.0::DOUBLE * {_D(_R)} / {_D(float(TARGET[1]))}", "0.0::DOUBLE",
)
_COS, _SIN = _D(math.cos(math.radians(ANGLE))), _D(math.sin(math.radians(ANGLE)))
_CORNERS = [(sx, sy) for sx, sy in ((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5))]
_PX = lambda sx, sy: (f"((xc + {_D(sx)} * w) * 640.0::DOUBLE - 320.0::DOUBLE)", f"((yc + {_D(sy)} * h) * 640.0::DOUBLE - 320.0::DOUBLE)")
_RX = ", ".join("({c} * {x} + {s} * {y} + 320.0::DOUBLE) / 640.0::DOUBLE".format(c=_COS, s=_SIN, x=_PX(*k)[0], y=_PX(*k)[1]) for k in _CORNERS)
_RY = ", ".join("({c} * {y} - {s} * {x} + 320.0::DOUBLE) / 640.0::DOUBLE".format(c=_COS, s=_SIN, x=_PX(*k)[0], y=_PX(*k)[1]) for k in _CORNERS)
_ROTATED = _cut(f"least({_RX})", f"least({_RY})", f"greatest({_RX})", f"greatest({_RY})", "0.01::DOUBLE")


def edge_or_multi_priority_topk(s, d):
    return sampling.for_review(v.normalised(s, d), 10, 42)


def _frames(s, d):
    c = F.col("c_custkey")
    split = F.when(c % 20 < 14, "train").when(c % 20 < 17, "val").otherwise("test")
    return table(s, d, "customer").select(c.alias("frame_id"), split.alias("split"))


_FRAMES = "fr AS (SELECT c_custkey AS frame_id, CASE WHEN c_custkey % 20 < 14 THEN 'train' WHEN c_custkey % 20 < 17 THEN 'val' ELSE 'test' END AS split FROM customer)"
_SPLIT_STATS = _FRAMES + """, e AS (SELECT frame_id, count(*) AS n, count_if(class_id = 0) AS n0, count_if(class_id = 1) AS n1, count_if(class_id = 2) AS n2 FROM gt GROUP BY 1),
st AS (SELECT split, count(*) AS images, coalesce(sum(n), 0)::BIGINT AS objects, count(n) AS positive, coalesce(sum(n0), 0)::BIGINT AS o0, coalesce(sum(n1), 0)::BIGINT AS o1, coalesce(sum(n2), 0)::BIGINT AS o2,
 count_if(n0 > 0)::BIGINT AS i0, count_if(n1 > 0)::BIGINT AS i1, count_if(n2 > 0)::BIGINT AS i2 FROM fr LEFT JOIN e USING (frame_id) GROUP BY split)"""


def class_counts_rollup(s, d):
    return stats.class_counts(v.gt_boxes(s, d))


def images_containing(s, d):
    return stats.images_containing(v.gt_boxes(s, d))


def class_combinations(s, d):
    return stats.class_combinations(_frames(s, d), v.gt_boxes(s, d))


def split_statistics(s, d):
    return stats.split_statistics(_frames(s, d), v.gt_boxes(s, d))


def split_deviation_warnings(s, d):
    return stats.deviation_warnings(split_statistics(s, d), 0.05)


def achieved_ratios(s, d):
    return stats.achieved_ratios(_frames(s, d))


def _sized(s, d):
    return stats.at_sizes(v.gt_boxes(s, d), [640, 320], SIDE)


def size_summary_grouping_sets(s, d):
    return stats.size_summary(_sized(s, d))


def size_buckets(s, d):
    return stats.size_buckets(_sized(s, d))


def size_by_imgsz(s, d):
    return _sized(s, d).groupBy("imgsz").agg(F.count("*").alias("n"), F.avg("width").alias("mean_width"), F.avg("height").alias("mean_height"), F.count_if(F.col("area") < 1024).alias("n_small"))


def balance_warnings(s, d):
    return stats.balance_warnings(_sized(s, d), _uneven(s, d), 0.2, 0.2)


def _uneven(s, d):
    """Boxes of which cracks stay in training only where their number ends in 0 to 3."""
    return v.gt_boxes(s, d).where("class_id <> 1 or box_id % 10 < 4")


def average_precision(s, d):
    return precision.average_precision(v.gt_boxes(s, d), v.pred_boxes(s, d))


def class_imbalance(s, d):
    return stats.class_imbalance(v.gt_boxes(s, d))


_SIZED = "sized AS (SELECT imgsz, class_id, (x2 - x1) * (imgsz / 640.0::DOUBLE) AS width, (y2 - y1) * (imgsz / 640.0::DOUBLE) AS height, (x2 - x1) * (imgsz / 640.0::DOUBLE) * ((y2 - y1) * (imgsz / 640.0::DOUBLE)) AS area FROM gt CROSS JOIN (VALUES (640), (320)) t(imgsz))"
_SUMMARY = ", ".join(
    f"min({c}) AS {c}_min, quantile_cont({c}, 0.25) AS {c}_p25, quantile_cont({c}, 0.5) AS {c}_median, quantile_cont({c}, 0.75) AS {c}_p75, max({c}) AS {c}_max, avg({c}) AS {c}_mean" for c in ("width", "height", "area")
)


def iou_pairs(s, d):
    return m.iou_pairs(v.gt_boxes(s, d), v.pred_boxes(s, d), 0.5)


def greedy_match_counts(s, d):
    return m.match_counts(v.gt_boxes(s, d), v.pred_boxes(s, d))


def match_totals_null(s, d):
    return m.totals(greedy_match_counts(s, d))


def match_totals_zero(s, d):
    return m.totals(greedy_match_counts(s, d), zero=True)


_INTER = "greatest(0, least(g.x2, p.x2) - greatest(g.x1, p.x1)) * greatest(0, least(g.y2, p.y2) - greatest(g.y1, p.y1))"
_IOU = f"""ious AS (SELECT frame_id, class_id, box_id, pred_id, i / CAST((gx + px - i) AS DOUBLE) AS iou FROM (
 SELECT g.frame_id, g.class_id, box_id, pred_id, {_INTER} AS i, (g.x2 - g.x1) * (g.y2 - g.y1) AS gx, (p.x2 - p.x1) * (p.y2 - p.y1) AS px
 FROM gt g JOIN pred p ON g.frame_id = p.frame_id AND g.class_id = p.class_id) WHERE i / CAST((gx + px - i) AS DOUBLE) >= 0.5)"""
_GREEDY = _IOU + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY frame_id, class_id ORDER BY iou DESC, box_id DESC, pred_id DESC) AS k FROM ious),
walk AS (SELECT DISTINCT frame_id, class_id, 0::BIGINT AS k, []::BIGINT[] AS bs, []::BIGINT[] AS ps FROM ranked
 UNION ALL SELECT w.frame_id, w.class_id, r.k, CASE WHEN list_contains(bs, box_id) OR list_contains(ps, pred_id) THEN bs ELSE list_append(bs, box_id) END,
 CASE WHEN list_contains(bs, box_id) OR list_contains(ps, pred_id) THEN ps ELSE list_append(ps, pred_id) END FROM walk w JOIN ranked r ON w.frame_id = r.frame_id AND w.class_id = r.class_id AND r.k = w.k + 1),
done AS (SELECT frame_id, class_id, max(len(bs)) AS tp FROM walk GROUP BY ALL),
counts AS (SELECT frame_id, class_id, coalesce(tp, 0)::BIGINT AS tp, (coalesce(np, 0) - coalesce(tp, 0))::BIGINT AS fp, (coalesce(ng, 0) - coalesce(tp, 0))::BIGINT AS fn
 FROM (SELECT frame_id, class_id, count(*) AS ng FROM gt GROUP BY ALL) a FULL JOIN (SELECT frame_id, class_id, count(*) AS np FROM pred GROUP BY ALL) b USING (frame_id, class_id) LEFT JOIN done USING (frame_id, class_id)),
tot AS (SELECT class_name, coalesce(sum(tp), 0)::BIGINT AS tp, coalesce(sum(fp), 0)::BIGINT AS fp, coalesce(sum(fn), 0)::BIGINT AS fn FROM classes LEFT JOIN counts USING (class_id) GROUP BY class_name),
sc AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE END AS r FROM tot)"""


def _matrix(s, d):
    return m.confusion(m.linked_pairs(v.gt_boxes(s, d), v.pred_boxes(s, d)))


def confusion_long(s, d):
    return _matrix(s, d)


def confusion_normalised(s, d):
    return m.column_normalised(_matrix(s, d))


def named_confusions(s, d):
    return m.named_confusions(_matrix(s, d))


_MATRIX = """links AS (SELECT p.class_id AS p, g.class_id AS a FROM gt g LEFT JOIN pred p ON p.pred_id = g.box_id * 2 UNION ALL SELECT class_id, NULL FROM pred WHERE pred_id % 2 = 1),
mx AS (SELECT coalesce(cp.class_name, 'background') AS predicted, coalesce(ca.class_name, 'background') AS actual, count(*) AS n
 FROM links LEFT JOIN classes cp ON links.p = cp.class_id LEFT JOIN classes ca ON links.a = ca.class_id GROUP BY ALL)"""
_NAMED = "nm AS (SELECT * FROM (VALUES ('pothole', 'manhole'), ('manhole', 'pothole'), ('crack', 'background'), ('pothole', 'background')) t(actual, predicted))"

QUERIES = {
    "boxes_to_pixels": (boxes_to_pixels, sql("""SELECT frame_id, box_id, greatest(0, least(600, round_even((xc - w / 2) * 600.0::DOUBLE, 0)::INT)) AS x1, greatest(0, least(450, round_even((yc - h / 2) * 450.0::DOUBLE, 0)::INT)) AS y1,
 greatest(0, least(600, round_even((xc + w / 2) * 600.0::DOUBLE, 0)::INT)) AS x2, greatest(0, least(450, round_even((yc + h / 2) * 450.0::DOUBLE, 0)::INT)) AS y2 FROM norm""", "norm")),
    "pixels_to_boxes": (pixels_to_boxes, sql("""SELECT box_id, xc, yc, floor(least((x2 - x1) / 640.0::DOUBLE, 2.0::DOUBLE * least(xc, 1.0::DOUBLE - xc)) * 1e8::DOUBLE) / 1e8::DOUBLE AS w,
 floor(least((y2 - y1) / 640.0::DOUBLE, 2.0::DOUBLE * least(yc, 1.0::DOUBLE - yc)) * 1e8::DOUBLE) / 1e8::DOUBLE AS h
 FROM (SELECT *, round_even((x1 + x2) / 2.0::DOUBLE / 640.0::DOUBLE * 1e8::DOUBLE, 0) / 1e8::DOUBLE AS xc, round_even((y1 + y2) / 2.0::DOUBLE / 640.0::DOUBLE * 1e8::DOUBLE, 0) / 1e8::DOUBLE AS yc FROM gt)""", "gt")),
    "canonical_labels": (canonical_labels, sql("""SELECT box_id, x AS xc, y AS yc,
 CASE WHEN x - a / 2 < 0 OR x + a / 2 > 1 THEN floor(least(a, 2.0::DOUBLE * least(x, 1.0::DOUBLE - x)) * 1e8::DOUBLE) / 1e8::DOUBLE ELSE a END AS w,
 CASE WHEN y - b / 2 < 0 OR y + b / 2 > 1 THEN floor(least(b, 2.0::DOUBLE * least(y, 1.0::DOUBLE - y)) * 1e8::DOUBLE) / 1e8::DOUBLE ELSE b END AS h
 FROM (SELECT box_id, round_even(xc * 1e8::DOUBLE, 0) / 1e8::DOUBLE AS x, round_even(yc * 1e8::DOUBLE, 0) / 1e8::DOUBLE AS y, round_even(w * 1e8::DOUBLE, 0) / 1e8::DOUBLE AS a, round_even(h * 1e8::DOUBLE, 0) / 1e8::DOUBLE AS b FROM norm)""", "norm")),
    "boxes_rescaled": (boxes_rescaled, sql(f"SELECT box_id, round_even(x1 * {_D(416 / 640)}, 0)::INT AS x1, round_even(y1 * 0.5::DOUBLE, 0)::INT AS y1, round_even(x2 * {_D(416 / 640)}, 0)::INT AS x2, round_even(y2 * 0.5::DOUBLE, 0)::INT AS y2 FROM gt", "gt")),
    "letterbox_boxes": (letterbox_boxes, sql(_LETTERBOX, "norm")),
    "flip_boxes": (flip_boxes, sql("SELECT box_id, 1.0::DOUBLE - xc AS xc, yc, w, h FROM norm", "norm")),
    "translate_boxes": (translate_boxes, sql(_around(f"xc + {_D(DX)}", f"yc + {_D(DY)}", "w", "h", "0.01::DOUBLE"), "norm")),
    "scale_boxes": (scale_boxes, sql(_around(f"0.5::DOUBLE + (xc - 0.5::DOUBLE) * {_D(SCALE)}", f"0.5::DOUBLE + (yc - 0.5::DOUBLE) * {_D(SCALE)}", f"w * {_D(SCALE)}", f"h * {_D(SCALE)}", "0.01::DOUBLE"), "norm")),
    "rotate_boxes": (rotate_boxes, sql(_ROTATED, "norm")),
    "pixel_box_problems": (pixel_box_problems, sql("""SELECT *, 'empty pixel bbox' AS problem FROM (SELECT frame_id, box_id, greatest(0, least(24, round_even((xc - w / 2) * 24.0::DOUBLE, 0)::INT)) AS x1, greatest(0, least(18, round_even((yc - h / 2) * 18.0::DOUBLE, 0)::INT)) AS y1,
 greatest(0, least(24, round_even((xc + w / 2) * 24.0::DOUBLE, 0)::INT)) AS x2, greatest(0, least(18, round_even((yc + h / 2) * 18.0::DOUBLE, 0)::INT)) AS y2 FROM norm) WHERE x2 <= x1 OR y2 <= y1""", "norm")),
    "in_frame_boxes": (in_frame_boxes, sql(f"SELECT box_id, x AS xc, yc, w, h FROM (SELECT *, xc + {_D(DX)} AS x FROM norm) WHERE w > 0 AND h > 0 AND x - w / 2 >= 0 AND yc - h / 2 >= 0 AND x + w / 2 <= 1 AND yc + h / 2 <= 1", "norm")),
    "edge_or_multi_priority_topk": (edge_or_multi_priority_topk, sql("""SELECT split, frame_id, priority, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY split ORDER BY priority, md5(concat('42:', frame_id)), frame_id) AS INT) AS rank FROM (
 SELECT split, frame_id, CASE WHEN bool_or(least(xc - w / 2, yc - h / 2, 1.0::DOUBLE - (xc + w / 2), 1.0::DOUBLE - (yc + h / 2)) < 0.03::DOUBLE) THEN 0 WHEN count(DISTINCT class_id) > 1 THEN 1 ELSE 2 END AS priority FROM norm GROUP BY ALL)) WHERE rank <= 10""", "norm")),
    "class_counts_rollup": (class_counts_rollup, sql("SELECT split, class_id, count(*) AS n_objects FROM gt GROUP BY ROLLUP (split, class_id)", "gt")),
    "images_containing": (images_containing, sql("SELECT s.split, c.class_name, count(DISTINCT g.frame_id) AS n_images FROM splits s CROSS JOIN classes c LEFT JOIN gt g ON g.split = s.split AND g.class_id = c.class_id GROUP BY ALL", "gt", "classes", "splits")),
    "class_combinations": (class_combinations, sql("""SELECT combination, count(f.frame_id) AS n_images FROM (VALUES ('', 'no object'), ('0', 'pothole only'), ('1', 'crack only'), ('2', 'manhole only'), ('0,1', 'pothole + crack'), ('0,2', 'pothole + manhole'), ('1,2', 'crack + manhole'), ('0,1,2', 'all 3 classes')) k(combo, combination)
 LEFT JOIN (SELECT frame_id, coalesce(c, '') AS combo FROM fr LEFT JOIN (SELECT frame_id, string_agg(DISTINCT class_id, ',' ORDER BY class_id) AS c FROM gt GROUP BY 1) USING (frame_id)) f USING (combo) GROUP BY combination""", "gt", extra=_FRAMES)),
    "split_statistics": (split_statistics, sql("""SELECT split, images, objects, o0 AS objects_0, o1 AS objects_1, o2 AS objects_2, 100.0::DOUBLE * o0 / greatest(objects, 1) AS class_pct_0, 100.0::DOUBLE * o1 / greatest(objects, 1) AS class_pct_1, 100.0::DOUBLE * o2 / greatest(objects, 1) AS class_pct_2,
 100.0::DOUBLE * positive / greatest(images, 1) AS positive_pct, 100.0::DOUBLE * i0 / greatest(images, 1) AS positive_pct_0, 100.0::DOUBLE * i1 / greatest(images, 1) AS positive_pct_1, 100.0::DOUBLE * i2 / greatest(images, 1) AS positive_pct_2, objects / greatest(images, 1)::DOUBLE AS objects_per_image FROM st""", "gt", extra=_SPLIT_STATS)),
    "split_deviation_warnings": (split_deviation_warnings, sql("""SELECT split, class_id, pct, overall_pct FROM (
 SELECT split, class_id, 100.0::DOUBLE * o / greatest(objects, 1) AS pct, 100.0::DOUBLE * sum(o) OVER (PARTITION BY class_id) / greatest(sum(objects) OVER (PARTITION BY class_id), 1) AS overall_pct
 FROM (SELECT split, objects, 0 AS class_id, o0 AS o FROM st UNION ALL SELECT split, objects, 1, o1 FROM st UNION ALL SELECT split, objects, 2, o2 FROM st)) WHERE abs(pct - overall_pct) > 0.05::DOUBLE""", "gt", extra=_SPLIT_STATS)),
    "achieved_ratios": (achieved_ratios, sql("SELECT split, count(frame_id) AS images, count(frame_id) / greatest((SELECT count(*) FROM fr), 1)::DOUBLE AS ratio FROM splits LEFT JOIN fr USING (split) GROUP BY split", "splits", extra=_FRAMES)),
    "size_summary_grouping_sets": (size_summary_grouping_sets, sql(f"SELECT imgsz, class_id, count(*) AS n, {_SUMMARY} FROM sized GROUP BY GROUPING SETS ((imgsz, class_id), (imgsz))", "gt", extra=_SIZED)),
    "size_buckets": (size_buckets, sql("""SELECT *, small / n::DOUBLE AS small_share, medium / n::DOUBLE AS medium_share, large / n::DOUBLE AS large_share FROM (
 SELECT imgsz, class_id, count(*) AS n, count_if(area < 1024)::BIGINT AS small, count_if(area >= 1024 AND area < 9216)::BIGINT AS medium, count_if(area >= 9216)::BIGINT AS large FROM sized GROUP BY ALL)""", "gt", extra=_SIZED)),
    "size_by_imgsz": (size_by_imgsz, sql("SELECT imgsz, count(*) AS n, avg(width) AS mean_width, avg(height) AS mean_height, count_if(area < 1024)::BIGINT AS n_small FROM sized GROUP BY imgsz", "gt", extra=_SIZED)),
    "balance_warnings": (balance_warnings, sql("""SELECT CASE WHEN class_id IS NULL THEN 'MANY_SMALL_OBJECTS_AT_320' ELSE concat('MANY_SMALL_', upper(class_name), '_AT_320') END AS code, 'HIGH' AS severity, value FROM (
 SELECT class_id, avg(CASE WHEN area < 1024 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS value FROM (SELECT class_id, ((x2 - x1) * 0.5::DOUBLE) * ((y2 - y1) * 0.5::DOUBLE) AS area FROM gt) GROUP BY ROLLUP (class_id)) LEFT JOIN classes USING (class_id) WHERE value >= 0.2
 UNION ALL SELECT 'CLASS_IMBALANCE', 'HIGH', max(n) / min(n)::DOUBLE FROM (SELECT class_id, count(*) AS n FROM gt WHERE split = 'train' AND (class_id <> 1 OR box_id % 10 < 4) GROUP BY class_id) HAVING max(n) / min(n)::DOUBLE >= 2""", "gt", "classes")),
    "average_precision": (average_precision, sql("""SELECT class_name, coalesce(n, 0)::BIGINT AS n_gt, (SELECT count(*) FROM pred p WHERE p.class_id = c.class_id) AS n_pred, CASE WHEN n > 0 THEN round(coalesce(ap, 0.0::DOUBLE), 4) END AS ap
 FROM classes c LEFT JOIN ng USING (class_id) LEFT JOIN (SELECT class_id, sum(tp * env) / max(n) AS ap FROM (
  SELECT class_id, n, tp, max(pr) OVER (PARTITION BY class_id ORDER BY confidence ROWS UNBOUNDED PRECEDING) AS env FROM (
   SELECT class_id, n, tp, confidence, (sum(tp) OVER w)::BIGINT / (sum(k) OVER w)::DOUBLE AS pr FROM pts JOIN ng USING (class_id) WINDOW w AS (PARTITION BY class_id ORDER BY confidence DESC))) GROUP BY class_id) USING (class_id)""", "pred", "classes", recursive=True, extra=_GREEDY + """,
 last AS (SELECT frame_id, class_id, max_by(ps, k) AS ps FROM walk GROUP BY ALL), hits AS (SELECT frame_id, class_id, unnest(ps) AS pred_id FROM last),
 pts AS (SELECT p.class_id, p.confidence, count(h.pred_id)::BIGINT AS tp, count(*) AS k FROM pred p LEFT JOIN hits h USING (frame_id, class_id, pred_id) GROUP BY ALL),
 ng AS (SELECT class_id, count(*) AS n FROM gt GROUP BY class_id)""")),
    "class_imbalance": (class_imbalance, sql("""SELECT class_name, objects, CASE WHEN a > 0 THEN objects / a::DOUBLE ELSE 0.0::DOUBLE END AS share, train_objects, CASE WHEN t > 0 THEN train_objects / t::DOUBLE ELSE 0.0::DOUBLE END AS train_share, ratio AS train_ratio,
 CASE WHEN ratio >= 2 THEN 'HIGH' WHEN ratio >= 1.5 THEN 'MODERATE' ELSE 'LOW' END AS level FROM (SELECT *, sum(objects) OVER () AS a, sum(train_objects) OVER () AS t,
 coalesce(max(nullif(train_objects, 0)) OVER () / (min(nullif(train_objects, 0)) OVER ())::DOUBLE, 0.0::DOUBLE) AS ratio FROM (
 SELECT class_name, count(box_id) AS objects, count_if(split = 'train')::BIGINT AS train_objects FROM classes LEFT JOIN gt USING (class_id) GROUP BY class_name))""", "gt", "classes")),
    "iou_pairs": (iou_pairs, sql("SELECT frame_id, class_id, box_id, pred_id, iou FROM ious", "pred", extra=_IOU)),
    "greedy_match_counts": (greedy_match_counts, sql("SELECT frame_id, class_id, tp, fp, fn FROM counts", "pred", "classes", recursive=True, extra=_GREEDY)),
    "match_totals_null": (match_totals_null, sql("SELECT class_name, tp, fp, fn, p AS precision, r AS recall FROM sc", "pred", "classes", recursive=True, extra=_GREEDY)),
    "match_totals_zero": (match_totals_zero, sql("SELECT class_name, tp, fp, fn, coalesce(p, 0) AS precision, coalesce(r, 0) AS recall, CASE WHEN p + r > 0 THEN 2.0::DOUBLE * p * r / (p + r) ELSE 0.0::DOUBLE END AS f1 FROM sc", "pred", "classes", recursive=True, extra=_GREEDY)),
    "confusion_long": (confusion_long, sql("SELECT predicted, actual, n FROM mx", "pred", "classes", extra=_MATRIX)),
    "confusion_normalised": (confusion_normalised, sql("SELECT predicted, actual, n, n / (sum(n) OVER (PARTITION BY actual))::DOUBLE AS rate FROM mx", "pred", "classes", extra=_MATRIX)),
    "named_confusions": (named_confusions, sql("""SELECT actual, predicted, coalesce(c, 0)::BIGINT AS count, coalesce(t, 0)::BIGINT AS actual_instances, CASE WHEN coalesce(t, 0) > 0 THEN coalesce(c, 0) / t::DOUBLE ELSE 0.0::DOUBLE END AS rate
 FROM (SELECT nm.*, (SELECT sum(n) FROM mx WHERE mx.actual = nm.actual AND mx.predicted = nm.predicted) AS c, (SELECT sum(n) FROM mx WHERE mx.actual = nm.actual) AS t FROM nm)""", "pred", "classes", extra=_MATRIX + ", " + _NAMED)),
}
