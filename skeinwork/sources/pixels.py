"""From the bytes of image files to pixels, an integrity verdict, and perceptual hashes.

PNG is read whole: every chunk's CRC, the inflated size, the five row filters. Rows' filters differ and a pixel depends on
those left of it and above, so pixels are restored by anti-diagonals, each in one numpy step whatever its rows' filters and for
all pictures of a shape that a batch holds.
Of JPEG the segments are walked and the scans must run up to the end marker; its pixels aren't decoded, so it has no hash."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.functions.hashing import threshold_bits
from skeinwork.functions.kernels import dct_block

PNG, JPEG = b"\x89PNG\r\n\x1a\n", b"\xff\xd8"
#: Of the transform's values: coefficients that are zero but for rounding shall not decide bits.
DECIMALS = 2
#: Samples of a pixel by PNG colour type.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


class Broken(ValueError):
    """Why a file can't be read."""


def chunks(content: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Kind and body of each PNG chunk up to IEND, CRCs tested."""
    at = len(PNG)
    while True:
        if at + 12 > len(content):
            raise Broken("truncated")
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body, crc = content[at + 8 : at + 8 + size], content[at + 8 + size : at + 12 + size]
        if len(crc) < 4:
            raise Broken("truncated")
        if zlib.crc32(kind + body) != int.from_bytes(crc, "big"):
            raise Broken("checksum")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size


def unfiltered(rows: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Samples (pictures, height, width, bytes of a pixel) of filtered rows, by each row's filter (pictures, height)."""
    k, h, w, n = rows.shape
    out = np.zeros((h + 1, w + 1, k, n), np.int32)  # a zero row above and column before
    rows, kinds = rows.transpose(1, 2, 0, 3), kinds.T
    for d in range(h + w - 1):
        y = np.arange(max(0, d - w + 1), min(h, d + 1))
        x = d - y
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        guess = left + up - corner
        near = np.where((abs(guess - left) <= abs(guess - up)) & (abs(guess - left) <= abs(guess - corner)), left, np.where(abs(guess - up) <= abs(guess - corner), up, corner))
        kind = kinds[y][:, :, None]
        out[y + 1, x + 1] = (rows[y, x] + np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) // 2, near], 0)) & 255
    return out[1:, 1:].transpose(2, 0, 1, 3).astype(np.uint8)


def png_lines(content: bytes) -> tuple[np.ndarray, np.ndarray, int, np.ndarray | None]:
    """Filtered rows (height, width, bytes of a pixel), each row's filter, bytes of a sample, the palette that must be looked up."""
    head, palette, data = None, None, []
    for kind, body in chunks(content):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
    if head is None:
        raise Broken("truncated")
    w, h, depth, colour, _, _, interlaced = head
    if not w or not h:
        raise Broken("empty")
    if colour not in SAMPLES or depth not in (8, 16) or interlaced:
        raise Broken("unsupported")
    try:
        raw = zlib.decompress(b"".join(data))
    except zlib.error as e:
        raise Broken("pixels") from e
    size = SAMPLES[colour] * depth // 8
    if len(raw) != h * (1 + w * size):
        raise Broken("pixels")
    lines = np.frombuffer(raw, np.uint8).reshape(h, 1 + w * size)
    if lines[:, 0].max() > 4:
        raise Broken("filter")
    return lines[:, 1:].reshape(h, w, size), lines[:, 0], depth // 8, (np.empty((0, 3), np.uint8) if palette is None else palette) if colour == 3 else None


def coloured(pixels: np.ndarray, sample: int, palette: np.ndarray | None) -> np.ndarray:
    """Height, width, channels of 8 bits (RGB order); samples of 16 bits lose their low byte, palettes are looked up."""
    pixels = pixels[:, :, ::sample]
    if palette is None:
        return pixels
    if pixels.max() >= len(palette):
        raise Broken("palette")
    return palette[pixels[:, :, 0]]


def png_pixels(content: bytes) -> np.ndarray:
    rows, kinds, sample, palette = png_lines(content)
    return coloured(unfiltered(rows[None], kinds[None])[0], sample, palette)


def jpeg_size(content: bytes) -> tuple[int, int, int]:
    """Height, width, channels, if the file's segments are whole and its scans run up to the end marker."""
    at, size = 2, None
    while at + 4 <= len(content):
        if content[at] != 0xFF:
            raise Broken("segments")
        mark = content[at + 1]
        if mark == 0xFF:
            at += 1
            continue
        if mark == 0xD9:
            break
        length = struct.unpack(">H", content[at + 2 : at + 4])[0]
        if at + 2 + length > len(content):
            raise Broken("truncated")
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            size = (*struct.unpack(">HH", content[at + 5 : at + 9]), content[at + 9])
        at += 2 + length
        if mark == 0xDA:  # entropy-coded data up to a marker that is neither stuffing nor a restart
            scan = np.frombuffer(content, np.uint8)[at:]
            marks = np.flatnonzero((scan[:-1] == 0xFF) & (scan[1:] != 0) & ((scan[1:] < 0xD0) | (scan[1:] > 0xD7)))
            if not len(marks) or not marks[0]:
                raise Broken("pixels")
            at += int(marks[0])
    if content[at : at + 2] != b"\xff\xd9":
        raise Broken("truncated")
    if size is None or not size[0] or not size[1]:
        raise Broken("empty")
    return size


Verdict = tuple[bool, "int | None", "int | None", "int | None", "str | None", "list[float] | None"]
#: Bytes of pixels that are held, to be restored together.
HELD = 1 << 22


def _judged(pixels: np.ndarray) -> Verdict:
    h, w, channels = pixels.shape
    if channels not in (1, 3, 4):
        return False, h, w, channels, "channels", None
    grey = pixels[:, :, 0] if channels == 1 else np.rint(pixels[:, :, :3] @ np.array([0.299, 0.587, 0.114]))
    return True, h, w, channels, None, np.round(dct_block(grey.astype(float)).astype(float), DECIMALS).ravel().tolist()


def verdicts(contents: Iterable[bytes | None]) -> list[Verdict]:
    """Of each file: ok, height, width, channels, reason, and the 64 values that a perceptual hash is of (PNG only). Pictures
    of one shape are restored together."""
    found: list[Verdict] = []
    waiting: dict[tuple, list[tuple]] = {}
    held = 0

    def told(at: int, make: Callable[[], Verdict | None]) -> None:
        try:
            found[at] = make() or found[at]
        except (Broken, struct.error, IndexError) as e:
            found[at] = (False, None, None, None, str(e) if isinstance(e, Broken) else "truncated", None)

    def restore() -> None:
        for some in waiting.values():
            pixels = unfiltered(np.stack([lines[0] for _, lines in some]), np.stack([lines[1] for _, lines in some]))
            for (at, (_, _, sample, palette)), each in zip(some, pixels, strict=True):
                told(at, lambda: _judged(coloured(each, sample, palette)))  # noqa: B023 - called at once
        waiting.clear()

    def read(at: int, content: bytes | None) -> Verdict | None:
        nonlocal held
        if not content:
            raise Broken("empty")
        if content.startswith(PNG):
            lines = png_lines(content)
            waiting.setdefault(lines[0].shape, []).append((at, lines))
            held += lines[0].size
            return None
        if content.startswith(JPEG):
            return True, *jpeg_size(content), None, None
        raise Broken("not_an_image")

    for at, content in enumerate(contents):
        found.append((False, None, None, None, None, None))
        told(at, lambda: read(at, content))  # noqa: B023 - called at once
        if held >= HELD:
            restore()
            held = 0
    restore()
    return found


def verdict(content: bytes | None) -> Verdict:
    return verdicts([content])[0]


def inspected(images: DataFrame, name: str = "name") -> DataFrame:
    """name, ok, height, width, channels, reason, sig_hi, sig_lo of image files (name, content): whether all of a file can be
    read, and its 64-bit perceptual hash, in one pass over the bytes."""
    schema = f"`{name}` {images.schema[name].dataType.simpleString()}, ok boolean, height int, width int, channels int, reason string, dct array<double>"

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = pd.DataFrame(verdicts(pdf["content"]), columns=["ok", "height", "width", "channels", "reason", "dct"])
            for c in ("height", "width", "channels"):
                rows[c] = rows[c].astype("Int32")
            rows.insert(0, name, pdf[name].to_numpy())
            yield rows

    found = images.select(name, "content").mapInPandas(run, schema)
    high, low = threshold_bits(F.col("dct"), 9, 64)
    has = F.col("dct").isNotNull()
    return found.select(name, "ok", "height", "width", "channels", "reason", F.when(has, high).alias("sig_hi"), F.when(has, low).alias("sig_lo"))


def png_bytes(pixels: np.ndarray, kinds: list[int]) -> bytes:
    """Pixels (height, width, channels of 8 bits) as a PNG whose rows take the given filters in turn."""
    h, w, n = pixels.shape
    wide = np.zeros((h + 1, w + 1, n), np.int32)
    wide[1:, 1:] = pixels
    left, up, corner = wide[1:, :-1], wide[:-1, 1:], wide[:-1, :-1]
    guess = left + up - corner
    near = np.where((abs(guess - left) <= abs(guess - up)) & (abs(guess - left) <= abs(guess - corner)), left, np.where(abs(guess - up) <= abs(guess - corner), up, corner))
    ways = np.stack([np.zeros_like(left), left, up, (left + up) // 2, near])
    kind = np.resize(kinds, h)
    body = ((pixels - ways[kind, np.arange(h)]) & 255).astype(np.uint8).reshape(h, w * n)
    part = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[n], 0, 0, 0)
    return PNG + part(b"IHDR", head) + part(b"IDAT", zlib.compress(np.column_stack((kind.astype(np.uint8), body)).tobytes())) + part(b"IEND", b"")
