"""Boxes as columns: pixels and fractions, overlap, letterbox, augmentation moves, sizes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from skeinwork.functions.annotations import eight, floored
from skeinwork.schema import CLASSES, LARGE_AREA, MEDIUM_AREA


def _cut(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def to_pixels(xc: Column, yc: Column, w: Column, h: Column, width: int, height: int) -> Column:
    """x1, y1, x2, y2, rounded half to even and cut to the image."""
    def px(x, size):
        return F.greatest(F.lit(0), F.least(F.lit(size), F.rint(x * F.lit(float(size))).cast("int")))

    return F.struct(px(xc - w / 2, width).alias("x1"), px(yc - h / 2, height).alias("y1"), px(xc + w / 2, width).alias("x2"), px(yc + h / 2, height).alias("y2"))


# Fixed value: why a label's box is no ground truth.
EMPTY_BOX = "empty pixel bbox"


def pixel_problem(box: Column) -> Column:
    """Why a pixel box (as of to_pixels) is no ground truth, or null: rounding left it without width or height."""
    return F.when((box["x2"] <= box["x1"]) | (box["y2"] <= box["y1"]), F.lit(EMPTY_BOX))


def to_label(x1: Column, y1: Column, x2: Column, y2: Column, width: int, height: int) -> Column:
    """xc, yc, w, h of a pixel box: centres of eight decimals, sizes floored so that no corner leaves the image."""
    xc, yc = eight((x1 + x2) / F.lit(2.0) / F.lit(float(width))), eight((y1 + y2) / F.lit(2.0) / F.lit(float(height)))
    w = floored(F.least((x2 - x1) / F.lit(float(width)), F.lit(2.0) * F.least(xc, F.lit(1.0) - xc)))
    h = floored(F.least((y2 - y1) / F.lit(float(height)), F.lit(2.0) * F.least(yc, F.lit(1.0) - yc)))
    return F.struct(xc.alias("xc"), yc.alias("yc"), w.alias("w"), h.alias("h"))


def rescaled(x: Column, source: int, target: int) -> Column:
    return F.rint(x * F.lit(target / source)).cast("int")


def overlap(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, Column]:
    """Areas of the intersection and of the union of two x1, y1, x2, y2 boxes."""
    zero = F.lit(0)
    both = F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    one = F.greatest(zero, a[2] - a[0]) * F.greatest(zero, a[3] - a[1])
    other = F.greatest(zero, b[2] - b[0]) * F.greatest(zero, b[3] - b[1])
    return both, one + other - both


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    both, union = overlap(a, b)
    return F.when(union == 0, F.lit(0.0)).otherwise(both / union)


def _between(xmin: Column, ymin: Column, xmax: Column, ymax: Column, least: float) -> Column:
    w, h = xmax - xmin, ymax - ymin
    box = F.struct(((xmin + xmax) / 2).alias("xc"), ((ymin + ymax) / 2).alias("yc"), w.alias("w"), h.alias("h"))
    return F.when((w > F.lit(least)) & (h > F.lit(least)), box)


def _around(xc: Column, yc: Column, w: Column, h: Column, least: float) -> Column:
    return _between(_cut(xc - w / 2), _cut(yc - h / 2), _cut(xc + w / 2), _cut(yc + h / 2), least)


def letterbox(xc: Column, yc: Column, w: Column, h: Column, source: tuple[int, int], target: tuple[int, int]) -> Column:
    """The box on the padded canvas; null if nothing of it is left. Sizes are (width, height)."""
    (ws, hs), (wt, ht) = source, target
    r = min(wt / ws, ht / hs)
    dw, dh = (wt - round(ws * r)) / 2, (ht - round(hs * r)) / 2
    lit = F.lit
    return _around((xc * lit(float(ws)) * lit(r) + lit(dw)) / lit(float(wt)), (yc * lit(float(hs)) * lit(r) + lit(dh)) / lit(float(ht)), w * lit(float(ws)) * lit(r) / lit(float(wt)), h * lit(float(hs)) * lit(r) / lit(float(ht)), 0.0)


def letterbox_padding(source: tuple[int, int], target: tuple[int, int]) -> tuple[int, int, int, int]:
    """Rows above and below, columns left and right."""
    (ws, hs), (wt, ht) = source, target
    r = min(wt / ws, ht / hs)
    dw, dh = (wt - round(ws * r)) / 2, (ht - round(hs * r)) / 2
    return round(dh - 0.1), round(dh + 0.1), round(dw - 0.1), round(dw + 0.1)


def flipped(xc: Column, yc: Column, w: Column, h: Column) -> Column:
    return F.struct((F.lit(1.0) - xc).alias("xc"), yc.alias("yc"), w.alias("w"), h.alias("h"))


def translated(xc: Column, yc: Column, w: Column, h: Column, dx: float, dy: float) -> Column:
    return _around(xc + F.lit(dx), yc + F.lit(dy), w, h, 0.01)


def scaled(xc: Column, yc: Column, w: Column, h: Column, by: float) -> Column:
    half, s = F.lit(0.5), F.lit(by)
    return _around(half + (xc - half) * s, half + (yc - half) * s, w * s, h * s, 0.01)


def rotated(xc: Column, yc: Column, w: Column, h: Column, degrees: float, width: int, height: int) -> Column:
    """The upright hull of the box turned about the image's centre."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    fw, fh = F.lit(float(width)), F.lit(float(height))
    cx, cy = F.lit(width / 2), F.lit(height / 2)
    xs, ys = [], []
    for sx, sy in ((-1, -1), (1, -1), (1, 1), (-1, 1)):
        x, y = (xc + F.lit(sx / 2) * w) * fw - cx, (yc + F.lit(sy / 2) * h) * fh - cy
        xs.append((F.lit(c) * x + F.lit(s) * y + cx) / fw)
        ys.append((F.lit(c) * y - F.lit(s) * x + cy) / fh)
    return _between(_cut(F.least(*xs)), _cut(F.least(*ys)), _cut(F.greatest(*xs)), _cut(F.greatest(*ys)), 0.01)


def in_frame(xc: Column, yc: Column, w: Column, h: Column, class_id: Column | None = None) -> Column:
    """The last filter after augmentation: finite, not empty, no corner outside. A class that isn't one is an error, not
    dropped, where `class_id` (any number) is given."""
    finite = ~(F.isnan(xc) | F.isnan(yc) | F.isnan(w) | F.isnan(h))
    if class_id is not None:
        known = F.coalesce(class_id.cast("double").isin(*(float(c) for c in CLASSES)), F.lit(False))
        wrong = F.raise_error(F.concat(F.lit("unsupported class_id "), F.coalesce(class_id.cast("string"), F.lit("null")))).cast("boolean")
        finite = F.when(known, finite).otherwise(wrong)
    return finite & (w > 0) & (h > 0) & (xc - w / 2 >= 0) & (yc - h / 2 >= 0) & (xc + w / 2 <= 1) & (yc + h / 2 <= 1)


# Ranges that augmentation may use: degrees, part of the image, factors.
SAFE_RANGES = {"rotation": (0.0, 10.0), "translate": (0.0, 0.05), "scale": (0.9, 1.1), "gamma": (0.8, 1.2)}


def check_ranges(config: dict[str, tuple[float, float]]) -> None:
    for name, (low, high) in config.items():
        a, b = SAFE_RANGES[name]
        if not a <= low <= high <= b:
            raise ValueError(f"{name} must stay within {a} and {b}")


def projected(w: Column, h: Column, width: Column, height: Column, imgsz: Column) -> Column:
    """Pixels of a fractional box at a square model input."""
    scale = F.least(imgsz / width, imgsz / height)
    return F.struct((w * width * scale).alias("width"), (h * height * scale).alias("height"), (w * width * scale * (h * height * scale)).alias("area"))


def size_class(area: Column) -> Column:
    return F.when(area < MEDIUM_AREA, "small").when(area < LARGE_AREA, "medium").otherwise("large")


def near_edge(xc: Column, yc: Column, w: Column, h: Column, margin: float = 0.03) -> Column:
    one = F.lit(1.0)
    return F.least(xc - w / 2, yc - h / 2, one - (xc + w / 2), one - (yc + h / 2)) < F.lit(margin)
