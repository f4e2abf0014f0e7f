"""Pixel kernels on uint8 arrays (height, width, channels; blue, green, red), and the stage pipeline over image rows.

Results follow the usual definitions; equality with a given vision library to the last bit is not sought."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame

PAD = 114  # fixed value: the grey of padding


def _padded(image: np.ndarray, k: int, mode: str) -> np.ndarray:
    return np.pad(image, ((k, k), (k, k), *([(0, 0)] * (image.ndim - 2))), mode=mode)


def _odd(k: int) -> int:
    return k if k % 2 else k + 1


def gaussian_blur(image: np.ndarray, kernel: int = 3, sigma: float = 0.5) -> np.ndarray:
    k = _odd(kernel) // 2
    w = np.exp(-0.5 * (np.arange(-k, k + 1) / sigma) ** 2)
    w /= w.sum()
    p = _padded(image, k, "reflect").astype(np.float64)
    h, wd = image.shape[:2]
    rows = sum(w[i] * p[i : i + h] for i in range(2 * k + 1))
    return np.clip(np.rint(sum(w[i] * rows[:, i : i + wd] for i in range(2 * k + 1))), 0, 255).astype(np.uint8)


def median_blur(image: np.ndarray, kernel: int = 3) -> np.ndarray:
    k = _odd(kernel) // 2
    p = _padded(image, k, "edge")
    h, w = image.shape[:2]
    return np.median([p[i : i + h, j : j + w] for i in range(2 * k + 1) for j in range(2 * k + 1)], axis=0).astype(np.uint8)


def global_contrast(image: np.ndarray, factor: float = 1.2) -> np.ndarray:
    return np.clip(np.rint(image * factor), 0, 255).astype(np.uint8)


def equalised(light: np.ndarray, clip: float = 2.0, tiles: tuple[int, int] = (8, 8)) -> np.ndarray:
    """Contrast-limited adaptive equalisation of one channel: a clipped histogram for each tile, blended between tiles."""
    h, w = light.shape
    ty, tx = min(tiles[0], h), min(tiles[1], w)
    ys, xs = np.linspace(0, h, ty + 1).astype(int), np.linspace(0, w, tx + 1).astype(int)
    maps = np.empty((ty, tx, 256))
    for i in range(ty):
        for j in range(tx):
            part = light[ys[i] : ys[i + 1], xs[j] : xs[j + 1]]
            hist = np.bincount(part.ravel(), minlength=256).astype(float)
            limit = max(1.0, clip * part.size / 256)
            over = np.maximum(hist - limit, 0).sum()
            maps[i, j] = np.cumsum(np.minimum(hist, limit) + over / 256) * 255 / part.size
    fy = np.clip((np.arange(h) + 0.5) * ty / h - 0.5, 0, ty - 1)
    fx = np.clip((np.arange(w) + 0.5) * tx / w - 0.5, 0, tx - 1)
    y0, x0 = fy.astype(int), fx.astype(int)
    y1, x1 = np.minimum(y0 + 1, ty - 1), np.minimum(x0 + 1, tx - 1)
    b, a = (fy - y0)[:, None], (fx - x0)[None, :]
    at = lambda y, x: maps[y[:, None], x[None, :], light]
    mixed = (1 - b) * ((1 - a) * at(y0, x0) + a * at(y0, x1)) + b * ((1 - a) * at(y1, x0) + a * at(y1, x1))
    return np.clip(np.rint(mixed), 0, 255).astype(np.uint8)


def clahe(image: np.ndarray, clip: float = 2.0, tiles: tuple[int, int] = (8, 8)) -> np.ndarray:
    """Adaptive equalisation of the luma, colours kept by their differences from it."""
    if image.ndim == 2:
        return equalised(image, clip, tiles)
    luma = image @ np.array([0.114, 0.587, 0.299])
    new = equalised(np.clip(np.rint(luma), 0, 255).astype(np.uint8), clip, tiles)
    return np.clip(np.rint(image + (new - luma)[..., None]), 0, 255).astype(np.uint8)


def brightness(image: np.ndarray, factor: float = 1.0) -> np.ndarray:
    """The value (largest channel) times the factor, hue and saturation kept."""
    if abs(factor - 1) < 1e-4:
        return image
    value = image.max(axis=-1).astype(float)
    scale = np.divide(np.clip(value * factor, 0, 255), value, out=np.zeros_like(value), where=value > 0)
    return np.clip(np.rint(image * scale[..., None]), 0, 255).astype(np.uint8)


def normalised(image: np.ndarray, mode: str = "pixel_scale", mean: tuple = (0.485, 0.456, 0.406), std: tuple = (0.229, 0.224, 0.225)) -> np.ndarray:
    if mode == "none":
        return image
    scaled = image.astype(np.float32) / np.float32(255)
    if mode == "pixel_scale":
        return scaled
    if mode == "standardize":
        return (scaled[..., ::-1] - np.array(mean, np.float32)) / np.array(std, np.float32)
    raise ValueError(f"unknown normalisation {mode}")


def resized(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, pixel centres at halves."""
    h, w = image.shape[:2]
    if (w, h) == (width, height):
        return image.copy()
    fy, fx = (np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1) for n, m in ((height, h), (width, w)))
    y0, x0 = fy.astype(int), fx.astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    shape = (1,) * (image.ndim - 2)
    b, a = (fy - y0).reshape(-1, 1, *shape), (fx - x0).reshape(1, -1, *shape)
    p = image.astype(float)
    out = (1 - b) * ((1 - a) * p[y0][:, x0] + a * p[y0][:, x1]) + b * ((1 - a) * p[y1][:, x0] + a * p[y1][:, x1])
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def letterboxed(image: np.ndarray, width: int, height: int) -> np.ndarray:
    h, w = image.shape[:2]
    r = min(width / w, height / h)
    inner = resized(image, round(w * r), round(h * r))
    dw, dh = (width - inner.shape[1]) / 2, (height - inner.shape[0]) / 2
    top, left = round(dh - 0.1), round(dw - 0.1)
    out = np.full((height, width, *image.shape[2:]), PAD, np.uint8)
    out[top : top + inner.shape[0], left : left + inner.shape[1]] = inner
    return out


def longest_side(image: np.ndarray, size: int | None) -> np.ndarray:
    """Smaller only, never larger."""
    h, w = image.shape[:2]
    if not size or max(h, w) <= size:
        return image
    return resized(image, round(w * size / max(h, w)), round(h * size / max(h, w)))


def gamma(image: np.ndarray, g: float) -> np.ndarray:
    if not 0.8 <= g <= 1.2:
        raise ValueError("gamma must stay within 0.8 and 1.2")
    return ((np.arange(256) / 255.0) ** g * 255.0).astype(np.uint8)[image]


def mask_boxes(mask: np.ndarray, least: int = 400, threshold: int = 127, class_id: int = 0) -> list[tuple[int, int, int, int, int]]:
    """class_id, x1, y1, x2, y2 of the 8-connected parts of a mask after an opening of 5 by 5, of `least` pixels or more."""
    grey = mask if mask.ndim == 2 else np.rint(mask @ np.array([0.114, 0.587, 0.299]))
    on = grey > threshold

    def spread(m: np.ndarray, keep: bool) -> np.ndarray:
        p = np.pad(m, 2, constant_values=keep)
        parts = [p[i : i + m.shape[0], j : j + m.shape[1]] for i in range(5) for j in range(5)]
        return np.logical_and.reduce(parts) if keep else np.logical_or.reduce(parts)

    on = spread(spread(on, True), False)
    root: list[int] = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    runs, last = [], []
    for y in range(on.shape[0]):
        edge = np.diff(np.concatenate(([0], on[y].astype(np.int8), [0])))
        now = []
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            k = len(root)
            root.append(k)
            for c, d, j in last:
                if c <= b and a <= d:  # touching, corners too
                    i, j = find(k), find(j)
                    root[max(i, j)] = min(i, j)
            now.append((a, b, k))
            runs.append((y, a, b, k))
        last = now
    parts: dict[int, list[int]] = {}
    for y, a, b, k in runs:
        p = parts.setdefault(find(k), [a, y, b, y + 1, 0])
        p[0], p[1], p[2], p[3], p[4] = min(p[0], a), min(p[1], y), max(p[2], b), max(p[3], y + 1), p[4] + b - a
    return [(class_id, *p[:4]) for p in parts.values() if p[4] >= least]


def dct_block(image: np.ndarray) -> np.ndarray:
    """Top left 8 by 8 of the cosine transform of the 32 by 32 mean-reduced grey image: what a perceptual hash is of."""
    grey = image if image.ndim == 2 else image @ np.array([0.114, 0.587, 0.299])
    h, w = grey.shape

    def areas(n: int) -> np.ndarray:
        edge = np.linspace(0, n, 33)
        at = np.arange(n)
        return np.clip(np.minimum(edge[1:, None], at + 1) - np.maximum(edge[:-1, None], at), 0, None) * 32 / n

    small = areas(h) @ grey @ areas(w).T
    k = np.arange(8)[:, None] * (2 * np.arange(32) + 1) * math.pi / 64
    c = np.cos(k) * np.sqrt(2 / 32)
    c[0] /= math.sqrt(2)
    return (c @ small @ c.T).astype(np.float32)


def process(image: np.ndarray, config: dict[str, Any]) -> np.ndarray:
    """Stages in their fixed order. Resize and normalisation are on unless turned off; others only if asked for."""
    resize = config.get("resize", {})
    if resize.get("enabled", True):
        size = resize.get("target_size", (640, 640))
        method = resize.get("method", "letterbox")
        if method not in ("letterbox", "direct"):
            raise ValueError(f"unknown resize {method}")
        image = (letterboxed if method == "letterbox" else resized)(image, *size)
    stages = (
        ("denoise", {"gaussian": lambda i, c: gaussian_blur(i, c.get("kernel", 3), c.get("sigma", 0.5)), "median": lambda i, c: median_blur(i, c.get("kernel", 3))}),
        ("contrast", {"clahe": lambda i, c: clahe(i, c.get("clip", 2.0)), "global": lambda i, c: global_contrast(i, c.get("factor", 1.2))}),
        ("brightness", {"value": lambda i, c: brightness(i, c.get("factor", 1.0))}),
    )
    for name, methods in stages:
        c = config.get(name, {})
        if c.get("enabled", False):
            method = c.get("method", next(iter(methods)))
            if method not in methods:
                raise ValueError(f"unknown {name} {method}")
            image = methods[method](image, c)
    c = config.get("normalize", {})
    return normalised(image, c.get("mode", "pixel_scale")) if c.get("enabled", True) else image


def process_rows(images: DataFrame, config: dict[str, Any]) -> DataFrame:
    """name, height, width, channels, data (raw uint8) through process(); results as float32 or uint8 bytes with their kind."""
    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            out = [process(np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels), config) for r in pdf.itertuples()]
            yield pdf.assign(height=[o.shape[0] for o in out], width=[o.shape[1] for o in out], kind=[str(o.dtype) for o in out], data=[np.ascontiguousarray(o).tobytes() for o in out])[
                ["name", "height", "width", "channels", "data", "kind"]
            ]

    return images.mapInPandas(run, "name string, height int, width int, channels int, data binary, kind string")
