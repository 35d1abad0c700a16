"""Operators over packed pixels: binary columns of 8-bit samples, row by row and pixel-interleaved, with h, w and bands beside them.

A byte a sample instead of a double: an Arrow batch of images is as large as the images. One image is one array in a task;
nothing is exploded. Null pixels or sizes give null.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from terragrid.functions.pixels import weights

#: Fixed value: the colour of overlay rings.
YELLOW = (255, 255, 0)


def _mapped(f: Callable[..., np.ndarray | None], *columns: Column) -> Column:
    """f(array (h, w, bands), *values) of each row, packed again. The first columns are data, h, w and bands."""

    @F.pandas_udf("binary")
    def run(data: pd.Series, h: pd.Series, w: pd.Series, bands: pd.Series, *more: pd.Series) -> pd.Series:
        out = []
        for x, a, b, n, *rest in zip(data, h, w, bands, *more):
            if x is None or pd.isna(a) or pd.isna(b) or pd.isna(n):
                out.append(None)
                continue
            y = f(np.frombuffer(x, np.uint8).reshape(int(a), int(b), int(n)), *rest)
            out.append(None if y is None else np.ascontiguousarray(y, np.uint8).tobytes())
        return pd.Series(out, dtype=object)

    return run(*columns)


def _key(*parts: Column) -> Column:
    return F.xxhash64(*parts)


def from_array(v: Column) -> Column:
    """Packed pixels of an array of numbers, rounded half to even and clipped."""

    @F.pandas_udf("binary")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else np.clip(np.rint(np.asarray(x, float)), 0, 255).astype(np.uint8).tobytes() for x in v], dtype=object)

    return run(v.cast("array<double>"))


def to_array(data: Column) -> Column:
    """The samples as array<int>."""

    @F.pandas_udf("array<int>")
    def run(data: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else np.frombuffer(x, np.uint8).astype(np.int32) for x in data])

    return run(data)


def rgb(data: Column, h: Column, w: Column, bands: Column, bgr: bool = False) -> Column:
    """Three bands: the first three, or of fewer the first one thrice; `bgr` turns them around."""
    return _mapped(lambda x: (x[:, :, :3] if x.shape[2] >= 3 else np.repeat(x[:, :, :1], 3, axis=2))[:, :, :: -1 if bgr else 1], data, h, w, bands)


def gray(data: Column, h: Column, w: Column, bands: Column) -> Column:
    """One band: luma of the first three (ITU-R 601 weights, as `pixels.luma`), or the first of fewer."""

    def one(x: np.ndarray) -> np.ndarray:
        if x.shape[2] < 3:
            return x[:, :, 0]
        return (x[:, :, :3].astype(np.int64) @ np.array([19595, 38470, 7471]) + 32768) >> 16

    return _mapped(one, data, h, w, bands)


def resized(data: Column, h: Column, w: Column, bands: Column, new_h: Column, new_w: Column, kind: str = "chebyshev") -> Column:
    """Each band at new_h x new_w, by two matrix products; rounded half to even (bicubic: truncated) and clipped."""
    weights(kind, 2, 2)

    def one(x: np.ndarray, mh: float, mw: float) -> np.ndarray | None:
        if pd.isna(mh) or pd.isna(mw) or min(mh, mw, *x.shape) < 1:
            return None
        y = np.einsum("ab,bcn,dc->adn", weights(kind, x.shape[0], int(mh)), x.astype(float), weights(kind, x.shape[1], int(mw)), optimize=True)
        return np.clip(np.trunc(y + 1e-9) if kind == "bicubic" else np.rint(y), 0, 255)

    return _mapped(one, data, h, w, bands, new_h, new_w)


def crop(data: Column, h: Column, w: Column, bands: Column, x0: Column, y0: Column, window: int) -> Column:
    """struct<data, mask> of a square window; pixels off the image are 0, with 0 in `mask` (one byte a pixel)."""

    @F.pandas_udf("data binary, mask binary")
    def run(data: pd.Series, h: pd.Series, w: pd.Series, bands: pd.Series, x0: pd.Series, y0: pd.Series) -> pd.DataFrame:
        rows = []
        for x, a, b, n, c, r in zip(data, h, w, bands, x0, y0):
            if x is None:
                rows.append((None, None))
                continue
            image, mask = np.zeros((window, window, n), np.uint8), np.zeros((window, window), np.uint8)
            top, left, bottom, right = max(r, 0), max(c, 0), min(r + window, a), min(c + window, b)
            if top < bottom and left < right:
                image[top - r : bottom - r, left - c : right - c] = np.frombuffer(x, np.uint8).reshape(a, b, n)[top:bottom, left:right]
                mask[top - r : bottom - r, left - c : right - c] = 1
            rows.append((image.tobytes(), mask.tobytes()))
        return pd.DataFrame(rows, columns=["data", "mask"])

    return run(data, h, w, bands, x0, y0)


def _blurred(x: np.ndarray) -> np.ndarray:
    """A 5 x 5 binomial blur with mirrored edges, of each band."""
    k = np.array([1, 4, 6, 4, 1]) / 16
    for axis in (0, 1):
        pad = [(2, 2) if i == axis else (0, 0) for i in range(x.ndim)]
        y = np.pad(x, pad, mode="reflect" if x.shape[axis] > 2 else "edge")
        x = sum(c * np.take(y, range(i, i + x.shape[axis]), axis=axis) for i, c in enumerate(k))
    return x


def noise_fill(data: Column, h: Column, w: Column, bands: Column, mask: Column, key: Column, level: float = 0.1, kind: str = "gaussian", seed: int = 0) -> Column:
    """Pixels whose mask is 0 become mean * (1 - level) + noise * level of their band, clipped and truncated.

    A band's mean is that of its valid pixels, 128 without any. gaussian: deviation 50; uniform: -255 to 255; perlin:
    normal noise of deviation 100 under a binomial blur. Equal keys and seeds give equal noise.
    """
    if kind not in ("gaussian", "uniform", "perlin"):
        raise ValueError("noise is gaussian, uniform or perlin")

    def one(x: np.ndarray, m: bytes, draw: int) -> np.ndarray:
        valid = np.frombuffer(m, np.uint8).reshape(x.shape[:2]) > 0
        if valid.all():
            return x
        mean = x[valid].mean(axis=0) if valid.any() else np.full(x.shape[2], 128.0)
        g = np.random.default_rng(int(draw) & ((1 << 63) - 1))
        noise = 0.0
        if level:
            noise = g.normal(0, 50, x.shape) if kind == "gaussian" else g.uniform(-255, 255, x.shape) if kind == "uniform" else _blurred(g.normal(0, 100, x.shape))
        fill = np.clip(np.broadcast_to(mean * (1 - level) + noise * level, x.shape), 0, 255)
        return np.where(valid[:, :, None], x, np.trunc(fill + 1e-9))

    return _mapped(one, data, h, w, bands, mask, _key(key, F.lit(seed)))


def _to_hsv(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue in turns, saturation and value of (h, w, 3) values from 0 to 1."""
    high, low = x.max(axis=2), x.min(axis=2)
    span = high - low
    safe = np.where(span > 0, span, 1)
    r, g, b = (x[:, :, i] for i in range(3))
    hue = np.where(high == r, ((g - b) / safe) % 6, np.where(high == g, (b - r) / safe + 2, (r - g) / safe + 4)) / 6
    return np.where(span > 0, hue, 0), np.where(high > 0, span / np.where(high > 0, high, 1), 0), high


def _to_rgb(h: np.ndarray, s: np.ndarray, v: np.ndarray) -> np.ndarray:
    k = (np.array([5, 3, 1]) + h[:, :, None] * 6) % 6
    return v[:, :, None] * (1 - s[:, :, None] * np.clip(np.minimum(k, 4 - k), 0, 1))


def jittered(x: np.ndarray, g: np.random.Generator, jitter: float, hue: float) -> np.ndarray:
    """Brightness, contrast, saturation and hue changed by chance, in a random order; (h, w, 3) values from 0 to 255."""
    y = x / 255.0
    luma = lambda z: z @ np.array([0.299, 0.587, 0.114])
    factor = g.uniform(1 - jitter, 1 + jitter, 3)
    turn = g.uniform(-hue, hue)
    for step in g.permutation(4):
        if step == 0:
            y = y * factor[0]
        elif step == 1:
            y = factor[1] * y + (1 - factor[1]) * luma(y).mean()
        elif step == 2:
            y = factor[2] * y + (1 - factor[2]) * luma(y)[:, :, None]
        else:
            h, s, v = _to_hsv(y)
            y = _to_rgb((h + turn) % 1, s, v)
        y = np.clip(y, 0, 1)
    return y * 255


def augmented(x: np.ndarray, draw: int, size: int = 224, turn: float = 15, shift: float = 0.1, jitter: float = 0.2, hue: float = 0.1) -> np.ndarray:
    """One random variant: turned, moved, colours changed, flipped by chance, cut to size x size (mirrored where smaller)."""
    g = np.random.default_rng(int(draw) & ((1 << 63) - 1))
    a, b = x.shape[:2]
    t, dx, dy = np.radians(g.uniform(-turn, turn)), np.rint(g.uniform(-shift, shift) * b), np.rint(g.uniform(-shift, shift) * a)
    r, c = np.indices((a, b)) - np.array([a - 1, b - 1]).reshape(2, 1, 1) / 2
    r, c = r - dy, c - dx
    y = np.rint(np.cos(t) * r - np.sin(t) * c + (a - 1) / 2).astype(int)
    z = np.rint(np.sin(t) * r + np.cos(t) * c + (b - 1) / 2).astype(int)
    on = (y >= 0) & (y < a) & (z >= 0) & (z < b)
    x = np.where(on[:, :, None], x[np.clip(y, 0, a - 1), np.clip(z, 0, b - 1)], 0)
    three = x.shape[2] == 3
    x = jittered(x if three else np.repeat(x[:, :, :1], 3, axis=2), g, jitter, hue)
    x = x[:, ::-1] if g.random() < 0.5 else x
    x = x[::-1] if g.random() < 0.5 else x
    pad = [max(0, size - s) for s in x.shape[:2]]
    if any(pad):
        x = np.pad(x, [(p, p) for p in pad] + [(0, 0)], mode="reflect" if min(a, b) > 1 else "edge")
    top, left = (int(g.integers(0, s - size + 1)) for s in x.shape[:2])
    x = np.clip(np.rint(x[top : top + size, left : left + size]), 0, 255)
    return x if three else x[:, :, :1]


def augment(data: Column, h: Column, w: Column, bands: Column, key: Column, copy: Column, seed: int = 0, size: int = 224, **amounts: float) -> Column:
    """A random variant of size x size of each image, fixed by key, copy and seed."""
    return _mapped(lambda x, draw: augmented(x, draw, size, **amounts), data, h, w, bands, _key(key, copy, F.lit(seed)))


def ring_mask(rings: Sequence[np.ndarray], h: int, w: int) -> np.ndarray:
    """(h, w) booleans: pixels whose centre lies inside, by the even-odd rule over all rings; parity along scan lines."""
    flips = np.zeros((h, w + 1), np.int64)
    for ring in rings:
        p = np.asarray(ring, float)[:, :2]
        for (x0, y0), (x1, y1) in zip(p, np.roll(p, -1, axis=0)):
            if y0 == y1:
                continue
            low, high = sorted((y0, y1))
            rows = np.arange(max(0, int(np.ceil(low - 0.5))), min(h, int(np.ceil(high - 0.5))))
            at = x0 + (rows + 0.5 - y0) * (x1 - x0) / (y1 - y0)
            np.add.at(flips, (rows, np.clip(np.ceil(at - 0.5), 0, w).astype(int)), 1)
    return np.cumsum(flips, axis=1)[:, :w] % 2 == 1


def ring_lines(rings: Sequence[np.ndarray], h: int, w: int, width: int = 2) -> np.ndarray:
    """(h, w) booleans: pixels of the rings' sides, drawn `width` pixels wide."""
    out = np.zeros((h, w), bool)
    for ring in rings:
        p = np.asarray(ring, float)[:, :2]
        for (x0, y0), (x1, y1) in zip(p, np.roll(p, -1, axis=0)):
            n = int(np.ceil(max(abs(x1 - x0), abs(y1 - y0)))) + 1
            x, y = (np.floor(np.linspace(s, e, n)).astype(int) for s, e in ((x0, x1), (y0, y1)))
            for dx in range(width):
                for dy in range(width):
                    r, c = y + dy - (width - 1) // 2, x + dx - (width - 1) // 2
                    on = (r >= 0) & (r < h) & (c >= 0) & (c < w)
                    out[r[on], c[on]] = True
    return out


def overlay(data: Column, h: Column, w: Column, bands: Column, rings: Column, color: tuple[int, int, int] = YELLOW, width: int = 2) -> Column:
    """The image as RGB with rings (array<array<array<double>>> of pixel coordinates) drawn over it."""

    def one(x: np.ndarray, some: Sequence) -> np.ndarray:
        x = (x[:, :, :3] if x.shape[2] >= 3 else np.repeat(x[:, :, :1], 3, axis=2)).copy()
        lines = [np.array([list(q)[:2] for q in ring], float) for ring in (some if some is not None else []) if ring is not None and len(ring)]
        x[ring_lines(lines, *x.shape[:2], width)] = color
        return x

    return _mapped(one, data, h, w, bands, rings)


def png(data: Column, h: Column, w: Column, bands: Column) -> Column:
    """8-bit PNG files: grey, or RGB of three bands or more."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    @F.pandas_udf("binary")
    def run(data: pd.Series, h: pd.Series, w: pd.Series, bands: pd.Series) -> pd.Series:
        out = []
        for x, a, b, n in zip(data, h, w, bands):
            if x is None:
                out.append(None)
                continue
            keep = 3 if n >= 3 else 1
            image = np.frombuffer(x, np.uint8).reshape(a, b, n)[:, :, :keep].reshape(a, b * keep)
            rows = np.concatenate([np.zeros((a, 1), np.uint8), image], axis=1)
            head = struct.pack(">IIBBBBB", b, a, 8, 2 if keep == 3 else 0, 0, 0, 0)
            out.append(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b""))
        return pd.Series(out, dtype=object)

    return run(data, h, w, bands)


def to_uint8(data: Column, dtype: Column) -> Column:
    """8-bit samples of packed pixels of any type: 8-bit ones as they are, others spread over 0 to 255 and truncated."""

    @F.pandas_udf("binary")
    def run(data: pd.Series, dtype: pd.Series) -> pd.Series:
        out = []
        for x, kind in zip(data, dtype):
            if x is None or kind == "uint8":
                out.append(x)
                continue
            v = np.frombuffer(x, np.dtype(kind).newbyteorder("<")).astype(float)
            low, high = (v.min(), v.max()) if len(v) else (0, 0)
            out.append((np.clip((v - low) / (high - low) if high > low else v, 0, 1) * 255).astype(np.uint8).tobytes())
        return pd.Series(out, dtype=object)

    return run(data, dtype)
