"""All texture metrics of an image at once: one decode, shared neighbour pairs, and equal-sized images measured as one stack.

The same metrics as single expressions are in `texture`. Here a missing pixel (null or NaN) makes hog, lbp_entropy and humoments
null; the others leave it out. Null images, sizes that don't fit the pixels and images without the pixels that a metric needs give
null, entropy without pairs is NaN, constant images have no moran (null), entropy 0 and correlation 1.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pixels that are measured at a time; a larger image is measured by itself.
PIXELS = 1 << 20


def measured(v: Column, h: Column, w: Column, names: Sequence[str], cell: int = 16) -> Column:
    """struct of a double for each name; v is array<double> or packed 8-bit grey (binary), `cell` the side of hog's cells."""
    unknown = [n for n in names if n not in KINDS]
    if unknown:
        raise ValueError(f"no such metrics: {unknown}")

    @F.arrow_udf(f"struct<{', '.join(f'{n}: double' for n in names)}>")
    def run(v: pa.Array, h: pa.Array, w: pa.Array) -> pa.Array:
        values, known = np.zeros((len(names), len(v))), np.zeros((len(names), len(v)), bool)
        if pa.types.is_binary(v.type):
            read = lambda k: np.frombuffer(v[k].as_buffer(), np.uint8)
        else:
            flat, ends = v.values.to_numpy(zero_copy_only=False), v.offsets.to_numpy()
            read = lambda k: flat[ends[k] : ends[k + 1]]
        shapes: dict[tuple[int, int], list[int]] = {}
        for k, (there, a, b) in enumerate(zip(v.is_valid().to_pylist(), h.to_pylist(), w.to_pylist())):
            if there and a is not None and b is not None and min(a, b) >= 0 and len(read(k)) == a * b:
                shapes.setdefault((a, b), []).append(k)
        for (a, b), rows in shapes.items():
            step = max(1, PIXELS // max(1, a * b))
            for first in range(0, len(rows), step):
                at = rows[first : first + step]
                stack = np.stack([read(k) for k in at]).astype(float).reshape(len(at), a, b)
                values[:, at], known[:, at] = measure(stack, names, cell)
        return pa.StructArray.from_arrays([pa.array(x, pa.float64(), mask=~y) for x, y in zip(values, known)], list(names))

    return run(v, h, w)


def measure(x: np.ndarray, names: Sequence[str], cell: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """The metrics of a stack (n, h, w) with NaN for missing pixels: (values, whether there is one), both (metrics, n)."""
    with np.errstate(all="ignore"):
        shared: dict[str, object] = {}
        found = [KINDS[name](x, shared, cell) for name in names]
        whole = np.isfinite(x).all(axis=(1, 2))
        known = [y & whole if name in ("hog", "lbp_entropy", "humoments") else y for name, (_, y) in zip(names, found)]
        return np.stack([y for y, _ in found]), np.stack(known)


def _moran(x: np.ndarray, shared: dict, cell: int) -> tuple[np.ndarray, np.ndarray]:
    held = ~np.isnan(x)
    n = held.sum(axis=(1, 2))
    mean = np.where(held, x, 0).sum(axis=(1, 2)) / np.maximum(n, 1)
    z = np.where(held, x - mean[:, None, None], 0.0)
    near, count = np.zeros_like(z), np.zeros(x.shape[1:])
    for to, of in ((np.s_[:, :-1], np.s_[:, 1:]), (np.s_[:, 1:], np.s_[:, :-1]), (np.s_[:-1], np.s_[1:]), (np.s_[1:], np.s_[:-1])):
        near[(slice(None), *(to if isinstance(to, tuple) else (to,)))] += z[(slice(None), *(of if isinstance(of, tuple) else (of,)))]
        count[to] += 1
    top, under = (z * near / np.maximum(count, 1)).sum(axis=(1, 2)), (z * z).sum(axis=(1, 2))
    flat = np.where(held, x, np.inf).min(axis=(1, 2), initial=np.inf) >= np.where(held, x, -np.inf).max(axis=(1, 2), initial=-np.inf)
    return top / under, (under > 0) & ~flat


def _counts(codes: np.ndarray, images: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(how often each code occurs in its image, its image)."""
    keys, counts = np.unique(images * (1 << 16) + codes, return_counts=True)
    return counts, keys >> 16


def _entropy(x: np.ndarray, shared: dict, cell: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(x)
    a, b = (np.concatenate([p.reshape(n, -1), q.reshape(n, -1)], axis=1) for p, q in ((x[:, :, :-1], x[:, :-1]), (x[:, :, 1:], x[:, 1:])))
    held = ~np.isnan(a) & ~np.isnan(b)
    low = np.where(held, np.minimum(a, b), np.inf).min(axis=1, initial=np.inf)[:, None]
    high = np.where(held, np.maximum(a, b), -np.inf).max(axis=1, initial=-np.inf)[:, None]
    binned = [np.minimum(255, np.nan_to_num(np.floor((p - low) * 256 / (high - low)))).astype(np.int64) for p in (a, b)]
    used = held & (high > low)
    counts, of = _counts((binned[0] * 256 + binned[1])[used], np.broadcast_to(np.arange(n)[:, None], used.shape)[used])
    share = counts / held.sum(axis=1)[of]
    bits = np.bincount(of, weights=-share * np.log2(share), minlength=n)
    return np.where(held.any(axis=1), bits, np.nan), np.ones(n, bool)


def _levels(x: np.ndarray, shared: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, whether both are there, pairs) of horizontal neighbours as 8-bit levels that wrap around, once a stack."""
    if "levels" not in shared:
        there = np.isfinite(x) & (np.abs(x) < 2.0**63)
        g = np.mod(np.trunc(np.where(there, x, 0)), 256).astype(np.int64)
        a, b, held = (p.reshape(len(x), -1) for p in (g[:, :, :-1], g[:, :, 1:], there[:, :, :-1] & there[:, :, 1:]))
        shared["levels"] = a, b, held, held.sum(axis=1)
    return shared["levels"]


def _contrast(x: np.ndarray, shared: dict, cell: int) -> tuple[np.ndarray, np.ndarray]:
    a, b, held, n = _levels(x, shared)
    return ((a - b) ** 2 * held).sum(axis=1) / n, n > 0


def _homogeneity(x: np.ndarray, shared: dict, cell: int) -> tuple[np.ndarray, np.ndarray]:
    a, b, held, n = _levels(x, shared)
    return (held / (1.0 + (a - b) ** 2)).sum(axis=1) / n, n > 0


def _energy(x: np.ndarray, shared: dict, cell: int) -> tuple[np.ndarray, np.ndarray]:
    a, b, held, n = _levels(x, shared)
    of = np.broadcast_to(np.arange(len(x))[:, None], held.shape)[held]
    counts, image = _counts(np.concatenate([a[held] * 256 + b[held], b[held] * 256 + a[held]]), np.concatenate([of, of]))
    return np.sqrt(np.bincount(image, weights=(counts / (2.0 * n[image])) ** 2, minlength=len(x))), n > 0


def _correlation(x: np.ndarray, shared: dict, cell: int) -> tuple[np.ndarray, np.ndarray]:
    a, b, held, n = _levels(x, shared)
    s, ab, q = (((f) * held).sum(axis=1) for f in (a + b, a * b, a * a + b * b))  # exact integers
    mu = s / (2.0 * n)
    var = q / (2.0 * n) - mu * mu
    return np.where(var < 1e-15, 1.0, (ab / n - mu * mu) / var), n > 0


def _humoments(x: np.ndarray, shared: dict, cell: int) -> tuple[np.ndarray, np.ndarray]:
    r, c = np.indices(x.shape[1:])
    mass = x.sum(axis=(1, 2))
    rm, cm = ((x * k).sum(axis=(1, 2)) / mass for k in (r, c))
    spread = (x * ((r - rm[:, None, None]) ** 2 + (c - cm[:, None, None]) ** 2)).sum(axis=(1, 2))
    return np.log10(np.abs(spread) + 1e-10), mass != 0


def _hog(x: np.ndarray, shared: dict, cell: int) -> tuple[np.ndarray, np.ndarray]:
    n, h, w = x.shape
    down, across = h // cell, w // cell
    if not n * down * across:
        return np.zeros(n), np.zeros(n, bool)
    gy, gx = np.zeros_like(x), np.zeros_like(x)
    gy[:, 1:-1], gx[:, :, 1:-1] = x[:, 2:] - x[:, :-2], x[:, :, 2:] - x[:, :, :-2]
    size = np.sqrt(gx * gx + gy * gy)
    way = np.minimum(8, np.nan_to_num(np.floor(np.degrees(np.arctan2(gy, gx)) % 180 * 9 / 180))).astype(np.int64)
    inner = np.s_[:, : down * cell, : across * cell]
    block = np.arange(down * cell)[:, None] // cell * across + np.arange(across * cell) // cell
    key = (np.arange(n)[:, None, None] * (down * across) + block) * 9 + way[inner]
    hist = np.bincount(key.ravel(), weights=np.nan_to_num(size[inner]).ravel(), minlength=n * down * across * 9).reshape(n, -1, 9) / cell**2
    unit = lambda k: k / np.sqrt((k * k).sum(axis=2, keepdims=True) + 1e-10)
    return (unit(np.minimum(unit(hist), 0.2)) ** 2).mean(axis=(1, 2)), np.ones(n, bool)


def _lbp_entropy(x: np.ndarray, shared: dict, cell: int) -> tuple[np.ndarray, np.ndarray]:
    n, h, w = x.shape
    a = round(2**-0.5, 5)
    pad = np.pad(x, ((0, 0), (1, 1), (1, 1)))
    at = lambda r, c: pad[:, 1 + r : 1 + r + h, 1 + c : 1 + c + w]
    ones, turns, first, last = np.zeros(x.shape, np.int64), np.zeros(x.shape, np.int64), None, None
    for r, c in ((0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1)):
        point = at(r, c) if not r or not c else (1 - a) * (1 - a) * x + (1 - a) * a * (at(r, 0) + at(0, c)) + a * a * at(r, c)
        bit = point - x >= -1e-9
        ones += bit
        first, turns, last = (bit, turns, bit) if last is None else (first, turns + (bit != last), bit)
    code = np.where(turns + (first != last) <= 2, ones, 9).reshape(n, -1)
    counts, of = _counts(code.ravel(), np.repeat(np.arange(n), h * w))
    share = counts / max(1, h * w)
    return np.bincount(of, weights=-share * np.log(share), minlength=n), np.full(n, h * w > 0)


#: Metric -> function of (stack, what metrics share, side of a cell), giving values and where there are any.
KINDS = {"moran": _moran, "entropy": _entropy, "contrast": _contrast, "homogeneity": _homogeneity, "energy": _energy, "correlation": _correlation, "humoments": _humoments, "hog": _hog, "lbp_entropy": _lbp_entropy}
