"""Random augmentation of training images with their boxes.

Every image draws from its own generator, seeded by its name and the run's seed, so results don't depend on the order or
the placement of rows. Boxes move with the pixels through one affine map per step; a box that leaves no more than a
hundredth of the image in either direction goes."""

from __future__ import annotations

import math
import zlib
from typing import Any

import numpy as np

from skeinwork.functions.geometry import check_ranges
from skeinwork.functions.kernels import PAD, gamma, gaussian_blur
from skeinwork.schema import CLASSES

Box = tuple[int, float, float, float, float]
LEAST = 0.01


def generator(name: str, seed: int) -> np.random.Generator:
    return np.random.default_rng([zlib.crc32(name.encode()), seed])


def warped(image: np.ndarray, forward: np.ndarray) -> np.ndarray:
    """The image moved by a 2 x 3 map of pixel coordinates, nearest pixel, grey outside."""
    h, w = image.shape[:2]
    inverse = np.linalg.inv(np.vstack((forward, (0, 0, 1))))
    y, x = np.mgrid[:h, :w]
    sx, sy = (np.rint(inverse[k, 0] * x + inverse[k, 1] * y + inverse[k, 2]).astype(int) for k in (0, 1))
    out = np.full_like(image, PAD)
    inside = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    out[inside] = image[sy[inside], sx[inside]]
    return out


def moved(boxes: list[Box], forward: np.ndarray, width: int, height: int) -> list[Box]:
    """The upright hulls of boxes under the map, cut to the image."""
    out = []
    for c, xc, yc, w, h in boxes:
        corners = np.array([[(xc + sx * w / 2) * width, (yc + sy * h / 2) * height, 1] for sx in (-1, 1) for sy in (-1, 1)])
        p = np.clip(corners @ forward.T / (width, height), 0, 1)
        (x1, y1), (x2, y2) = p.min(0), p.max(0)
        if x2 - x1 > LEAST and y2 - y1 > LEAST:
            out.append((c, (x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1))
    return out


def about_centre(width: int, height: int, degrees: float, scale: float) -> np.ndarray:
    c, s = scale * math.cos(math.radians(degrees)), scale * math.sin(math.radians(degrees))
    x, y = width / 2, height / 2
    return np.array([[c, s, x - c * x - s * y], [-s, c, y + s * x - c * y]])


def kept(boxes: list[Box]) -> list[Box]:
    """Finite boxes inside the frame; a class that isn't one of ours is an error, not a filter."""
    for b in boxes:
        if b[0] not in CLASSES:
            raise ValueError(f"unsupported class {b[0]}")
    ok = lambda b: all(map(math.isfinite, b[1:])) and b[3] > 0 and b[4] > 0
    return [b for b in boxes if ok(b) and min(b[1] - b[3] / 2, b[2] - b[4] / 2) >= 0 and max(b[1] + b[3] / 2, b[2] + b[4] / 2) <= 1]


def augmented(name: str, image: np.ndarray, boxes: list[Box], config: dict[str, Any], split: str = "train", seed: int = 42) -> tuple[np.ndarray, list[Box]]:
    """Flip, shift, scale, turn, light, gamma, blur and noise, each with its probability; only for training images.

    config: step -> {"prob", and "range" or its limits}; limits are checked against the safe ranges."""
    if split != "train" or not config.get("enabled", False):
        return image.copy(), list(boxes)
    rng = generator(name, seed)
    h, w = image.shape[:2]

    def drawn(step: str) -> dict[str, Any] | None:
        c = config.get(step, {})
        return c if rng.random() < c.get("prob", 0.0) else None

    if drawn("flip") is not None:
        image, boxes = image[:, ::-1].copy(), [(c, 1 - x, y, a, b) for c, x, y, a, b in boxes]
    if (c := drawn("translate")) is not None:
        most = c.get("range", 0.05)
        check_ranges({"translate": (0.0, most)})
        dx, dy = rng.uniform(-most, most, 2)
        m = np.array([[1, 0, dx * w], [0, 1, dy * h]])
        image, boxes = warped(image, m), moved(boxes, m, w, h)
    if (c := drawn("scale")) is not None:
        limits = c.get("range", (0.9, 1.1))
        check_ranges({"scale": limits})
        m = about_centre(w, h, 0.0, rng.uniform(*limits))
        image, boxes = warped(image, m), moved(boxes, m, w, h)
    if (c := drawn("rotation")) is not None:
        most = c.get("range", 10.0)
        check_ranges({"rotation": (0.0, most)})
        m = about_centre(w, h, rng.uniform(-most, most), 1.0)
        image, boxes = warped(image, m), moved(boxes, m, w, h)
    if (c := drawn("light")) is not None:
        contrast, light = rng.uniform(*c.get("contrast", (0.8, 1.2))), rng.uniform(*c.get("brightness", (0.8, 1.2)))
        image = np.clip(np.rint(image * contrast + (light - 1) * 255), 0, 255).astype(np.uint8)
    if (c := drawn("gamma")) is not None:
        limits = c.get("range", (0.9, 1.1))
        check_ranges({"gamma": limits})
        image = gamma(image, rng.uniform(*limits))
    if (c := drawn("blur_noise")) is not None:
        if rng.random() < 0.5:
            image = gaussian_blur(image, c.get("kernel", 3), 0.8)
        if rng.random() < 0.5:
            image = np.clip(image + rng.normal(0, c.get("std", 5.0), image.shape), 0, 255).astype(np.uint8)
    return image, kept(boxes)
