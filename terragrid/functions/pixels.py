"""Pixel transforms: expressions over packed arrays, and resampling by two small matrix products a band.

Arrays are row-major doubles with h and w beside them. Null arrays give null.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from terragrid.functions.arrays import let, mean, upto


def luma(r: Column, g: Column, b: Column) -> Column:
    """8-bit luma by the public ITU-R 601 weights, in sixteenths of a bit, rounded half up."""
    return F.floor((r * 19595 + g * 38470 + b * 7471 + 32768) / 65536).cast("int")


def clip_uint8(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), x)).cast("int")


def minmax_to_uint8(v: Column) -> Column:
    """Values spread over 0 to 255, truncated; a constant image is only multiplied by 255 and clipped."""

    def of(r: Column) -> Column:
        span = r["high"] - r["low"]
        return F.transform(v, lambda x: F.when(span > 0, F.floor((x - r["low"]) / F.nullif(span, F.lit(0.0)) * 255)).otherwise(F.floor(clip_uint8(x * 255))).cast("int"))

    return let(F.struct(F.array_min(v).alias("low"), F.array_max(v).alias("high")), of)


def bands(v: Column, n: int, keep: int = 3) -> Column:
    """array of the first `keep` bands of pixel-interleaved values with n bands."""
    return F.array(*[F.filter(v, lambda x, i, k=k: i % n == k) for k in range(min(keep, n))])


def _uniform(key: Column, i: Column, seed: int, stream: int) -> Column:
    """In (0, 1), fixed by key, place and seed."""
    return (F.pmod(F.xxhash64(key, i, F.lit(seed), F.lit(stream)), F.lit(1 << 30)) + 0.5) / float(1 << 30)


def _normal(key: Column, i: Column, seed: int) -> Column:
    return F.sqrt(-2.0 * F.log(_uniform(key, i, seed, 0))) * F.cos(2 * np.pi * _uniform(key, i, seed, 1))


def noise_fill(v: Column, valid: Column, key: Column, level: float = 0.1, kind: str = "gaussian", seed: int = 0, w: Column | None = None) -> Column:
    """`v` with pixels where `valid` (array<int>) is 0 replaced by mean * (1 - level) + noise * level, clipped to 0..255.

    The mean is that of the valid pixels, 128 without any. gaussian: deviation 50; uniform: -255 to 255; perlin: normal
    noise of deviation 100 under a 5x5 binomial blur (needs `w`; edges are mirrored). Equal keys, places and seeds give
    equal noise.
    """
    if kind == "gaussian":
        noise = lambda i, n: 50.0 * _normal(key, i, seed)
    elif kind == "uniform":
        noise = lambda i, n: 510.0 * _uniform(key, i, seed, 0) - 255.0
    elif kind == "perlin":
        if w is None:
            raise ValueError("perlin noise needs the image's width")
        weights = (1, 4, 6, 4, 1)
        mirror = lambda x, size: F.when(x < 0, F.least(-x, size - 1)).when(x >= size, F.greatest(F.lit(0), 2 * size - 2 - x)).otherwise(x)

        def noise(i: Column, n: Column) -> Column:
            h = F.ceil(n / w)
            out = F.lit(0.0)
            for dr, a in zip(range(-2, 3), weights):
                for dc, b in zip(range(-2, 3), weights):
                    j = mirror(F.floor(i / w) + dr, h) * w + mirror(i % w + dc, w)
                    out = out + a * b / 256 * 100.0 * _normal(key, j.cast("int"), seed)
            return out
    else:
        raise ValueError("noise is gaussian, uniform or perlin")
    base = F.coalesce(mean(F.filter(v, lambda x, i: F.get(valid, i) > 0)), F.lit(128.0))
    blend = lambda m, i: m * (1 - level) + (noise(i, F.size(v)) * level if level else F.lit(0.0))
    filled = let(base, lambda m: F.transform(v, lambda x, i: F.when(F.get(valid, i) > 0, x).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(255.0), blend(m, i))))))
    return F.when(F.exists(valid, lambda x: x == 0), filled).otherwise(v)


def crop(v: Column, h: Column, w: Column, x0: Column, y0: Column, window: int) -> Column:
    """struct<v, mask> of a window; pixels off the image are 0 with mask 0."""

    def at(i: Column) -> Column:
        r, c = y0 + F.floor(i / window), x0 + i % window
        return F.when((r >= 0) & (r < h) & (c >= 0) & (c < w), F.get(v, (r * w + c).cast("int")))

    return let(F.transform(upto(F.lit(window * window)), at), lambda x: F.struct(F.transform(x, lambda p: F.coalesce(p, F.lit(0.0))).alias("v"), F.transform(x, lambda p: p.isNotNull().cast("int")).alias("mask")))


@lru_cache(maxsize=256)
def weights(kind: str, n: int, m: int) -> np.ndarray:
    """(m, n) matrix that resamples n values to m.

    chebyshev: Lagrange interpolation at Chebyshev nodes, as a product of cosine transforms. bilinear: triangle filter,
    widened when shrinking. bicubic: Keys' kernel with a = -1/2, edges repeated. spline: interpolating cubic B-spline, edges
    mirrored, after a Gaussian blur of deviation (n / m - 1) / 2 when shrinking.
    """
    if kind == "chebyshev":
        k = np.arange(1, n)
        to = np.pi * (2 * np.arange(1, m + 1) - 1) / (2 * m)
        of = np.pi * (2 * np.arange(n) + 1) / (2 * n)
        return 1 / n + 2 / n * np.cos(np.outer(to, k)) @ np.cos(np.outer(k, of))
    scale = n / m
    centre = (np.arange(m) + 0.5) * scale
    if kind == "bilinear":
        reach = max(scale, 1.0)
        x = np.abs((np.arange(n) + 0.5)[None] - centre[:, None]) / reach
        out = np.maximum(1 - x, 0)
        return out / out.sum(axis=1, keepdims=True)
    if kind == "bicubic":
        out = np.zeros((m, n))
        first = np.floor(centre - 0.5).astype(int) - 1
        for j in range(4):
            x = np.abs(centre - 0.5 - (first + j))
            a = np.where(x <= 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x < 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0))
            np.add.at(out, (np.arange(m), np.clip(first + j, 0, n - 1)), a)
        return out
    if kind == "spline":
        out = np.zeros((m, n))
        first = np.floor(centre - 0.5).astype(int) - 1
        for j in range(4):
            x = np.abs(centre - 0.5 - (first + j))
            np.add.at(out, (np.arange(m), _mirrored(first + j, n)), np.where(x < 1, 2 / 3 - x**2 + x**3 / 2, np.maximum(2 - x, 0) ** 3 / 6))
        return out @ _spline_coefficients(_blur((scale - 1) / 2, n))
    raise ValueError("resampling is chebyshev, bilinear, bicubic or spline")


def _mirrored(i: np.ndarray, n: int) -> np.ndarray:
    """Places on n values that go on beyond the ends as in mirrors on the first and the last one."""
    return n - 1 - np.abs(i % (2 * n - 2) - (n - 1)) if n > 1 else np.zeros_like(i)


def _blur(deviation: float, n: int) -> np.ndarray:
    """(n, n) matrix of a Gaussian blur that reaches four deviations; the identity for none."""
    out = np.zeros((n, n))
    reach = int(4 * max(deviation, 0.0) + 0.5)
    k = np.arange(-reach, reach + 1)
    share = np.exp(-0.5 * (k / deviation) ** 2) if reach else np.ones(1)
    for j, x in zip(k, share / share.sum()):
        np.add.at(out, (np.arange(n), _mirrored(np.arange(n) + j, n)), x)
    return out


def _spline_coefficients(values: np.ndarray) -> np.ndarray:
    """Coefficients of the cubic B-splines through the columns' values: a tridiagonal system, swept forth and back."""
    n = len(values)
    if n == 1:
        return values
    out = 6.0 * values
    ratio = np.zeros(n)
    ratio[0], out[0] = 0.5, out[0] / 4
    for i in range(1, n):
        below = 2.0 if i == n - 1 else 1.0
        under = 4 - below * ratio[i - 1]
        ratio[i], out[i] = 1 / under, (out[i] - below * out[i - 1]) / under
    for i in range(n - 2, -1, -1):
        out[i] -= ratio[i] * out[i + 1]
    return out


def resized(v: Column, h: Column, w: Column, new_h: Column, new_w: Column, kind: str = "chebyshev") -> Column:
    """The image at new_h x new_w, rounded half to even (bicubic, spline: truncated) and clipped to 0..255, spline also to the
    image's own range.

    One image is two matrix products in an Arrow batch; matrices are kept per size. Sizes below 1 give null.
    """
    weights(kind, 2, 2)

    @F.pandas_udf("array<double>")
    def run(v: pd.Series, h: pd.Series, w: pd.Series, mh: pd.Series, mw: pd.Series) -> pd.Series:
        out = []
        for x, a, b, c, d in zip(v, h, w, mh, mw):
            if x is None or pd.isna([a, b, c, d]).any() or min(a, b, c, d) < 1:
                out.append(None)
                continue
            y = weights(kind, int(a), int(c)) @ np.asarray(x, float).reshape(int(a), int(b)) @ weights(kind, int(b), int(d)).T
            y = np.clip(y, np.min(x), np.max(x)) if kind == "spline" else y
            out.append(np.clip(np.trunc(y + 1e-9) if kind in ("bicubic", "spline") else np.rint(y), 0, 255).ravel())
        return pd.Series(out)

    return run(v.cast("array<double>"), h, w, new_h, new_w)


def augment(v: Column, h: Column, w: Column, key: Column, copy: Column, seed: int = 0, turn: float = 15, shift: float = 0.1, jitter: float = 0.2) -> Column:
    """One random variant of an image, of the same size: turned by up to `turn` degrees, moved by up to `shift` of its
    side, brightness and contrast changed by up to `jitter`, flipped both ways by chance. Fixed by key, copy and seed."""

    @F.pandas_udf("array<double>")
    def run(v: pd.Series, h: pd.Series, w: pd.Series, draw: pd.Series) -> pd.Series:
        out = []
        for x, a, b, s in zip(v, h, w, draw):
            if x is None:
                out.append(None)
                continue
            g = np.random.default_rng(int(s) & ((1 << 63) - 1))
            img = np.asarray(x, float).reshape(int(a), int(b))
            t, dx, dy = np.radians(g.uniform(-turn, turn)), g.uniform(-shift, shift) * b, g.uniform(-shift, shift) * a
            r, c = np.indices(img.shape) - np.array([a - 1, b - 1]).reshape(2, 1, 1) / 2
            y, z = np.rint(np.cos(t) * r - np.sin(t) * c + (a - 1) / 2 - dy).astype(int), np.rint(np.sin(t) * r + np.cos(t) * c + (b - 1) / 2 - dx).astype(int)
            on = (y >= 0) & (y < a) & (z >= 0) & (z < b)
            img = np.where(on, img[np.clip(y, 0, int(a) - 1), np.clip(z, 0, int(b) - 1)], 0)
            img = img * g.uniform(1 - jitter, 1 + jitter)
            img = (img - img.mean()) * g.uniform(1 - jitter, 1 + jitter) + img.mean()
            img = img[:, ::-1] if g.random() < 0.5 else img
            img = img[::-1] if g.random() < 0.5 else img
            out.append(np.clip(np.rint(img), 0, 255).ravel())
        return pd.Series(out)

    return run(v.cast("array<double>"), h, w, F.xxhash64(key, copy, F.lit(seed)))


#: Name -> resampling of the comparison of resizing methods.
RESIZERS: dict[str, Callable[[Column, Column, Column, Column, Column], Column]] = {
    kind: lambda v, h, w, mh, mw, kind=kind: resized(v, h, w, mh, mw, kind) for kind in ("chebyshev", "bilinear", "bicubic", "spline")
}
