"""Validity of polygons: no ring crosses, touches or folds on itself, holes lie inside and leave the interior in one piece.

A sweep along one axis finds the pairs of sides whose boxes meet; only these are judged, by turns whose signs are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pairs of sides that are judged at a time.
PAIRS = 1 << 18
#: Points of the polygons that are judged together.
POINTS = 1 << 17
#: Relative error that the products of a turn may have in doubles.
ERROR = 4 * np.finfo(float).eps


def valid_polygon(ring: Column, holes: Column | None = None) -> Column:
    """Whether a ring (closed or not, points array<double>) with its holes is a valid polygon; null for a null ring.

    Repeated points in a row are allowed. A hole may touch the ring or another hole in points, if the interior stays
    connected. Rings of fewer than three different points or with missing or infinite coordinates aren't valid. A null hole
    counts as none. Arrow batches of flat coordinates; the cost is the sort of a ring's sides and the pairs of sides whose boxes meet.
    """
    flat = lambda r: F.flatten(F.transform(r, lambda p: F.array(F.get(p, F.lit(0)).cast("double"), F.get(p, F.lit(1)).cast("double"))))
    ring_ = F.coalesce(ring, F.array().cast("array<array<double>>"))
    rings = F.array(ring_) if holes is None else F.concat(F.array(ring_), F.filter(F.coalesce(holes, F.array().cast("array<array<array<double>>>")), lambda r: r.isNotNull()))

    @F.pandas_udf("boolean")
    def judge(points: pd.Series, sizes: pd.Series) -> pd.Series:
        ends = np.cumsum([len(p) // 2 for p in points])
        out = np.zeros(len(points), bool)
        first = 0
        while first < len(points):  # slices of bounded size; a larger polygon is one of its own
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + POINTS, side="right")))
            rows = range(first, last)
            flat = np.concatenate([np.asarray(points.iloc[k], dtype=float) for k in rows]).reshape(-1, 2)
            rings = np.concatenate([np.asarray(sizes.iloc[k], dtype=int) for k in rows])
            of = np.repeat(np.arange(last - first), [len(sizes.iloc[k]) for k in rows])
            out[first:last] = valid(flat, rings, of)
            first = last
        return pd.Series(out)

    return F.when(ring.isNotNull(), judge(F.flatten(F.transform(rings, flat)), F.transform(rings, lambda r: F.size(r))))


def valid(points: np.ndarray, sizes: np.ndarray, polygon: np.ndarray) -> np.ndarray:
    """Validity of polygons, all judged together: (n, 2) points, the number of points and the polygon (0, 1, ...) of each ring;
    a polygon's first ring is its outer one."""
    good = np.ones(int(polygon.max()) + 1 if len(polygon) else 0, bool)
    ring = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.cumsum(sizes) - sizes
    index = np.arange(len(points))
    before = np.where(index == starts[ring], starts[ring] + sizes[ring] - 1, index - 1)
    good[polygon[ring[~np.isfinite(points).all(axis=1)]]] = False
    kept = (points != points[before]).any(axis=1)  # a point that repeats the one before is none
    good[polygon[np.bincount(ring[kept], minlength=len(sizes)) < 3]] = False
    kept &= good[polygon[ring]]
    a, ring = points[kept], ring[kept]
    if not len(a):
        return good
    size = np.bincount(ring, minlength=len(sizes))
    starts, size = (np.cumsum(size) - size)[ring], size[ring]
    at, of = np.arange(len(a)) - starts, polygon[ring]
    b, after = (a[starts + (at + k) % size] for k in (1, 2))
    straight = _turn(a, b, after) == 0
    good[of[straight & (((b - a) * (after - b)).sum(axis=1) < 0)]] = False  # a side folds back on the one before
    touches: dict[int, set[tuple[int, float, float]]] = {}
    low, high = np.minimum(a, b), np.maximum(a, b)
    for i, j in _meeting(low, high, of):
        gap = np.abs(at[i] - at[j])
        apart = (ring[i] != ring[j]) | ((gap != 1) & (gap != size[i] - 1))
        i, j = i[apart], j[apart]
        t = [_turn(*p) for p in ((a[i], b[i], a[j]), (a[i], b[i], b[j]), (a[j], b[j], a[i]), (a[j], b[j], b[i]))]
        cross = (t[0] * t[1] < 0) & (t[2] * t[3] < 0)
        shared = ((np.minimum(high[i], high[j]) - np.maximum(low[i], low[j])) > 0).any(axis=1)
        good[of[i[cross | ((t[0] == 0) & (t[1] == 0) & shared)]]] = False
        for turn, p, on in ((t[0], a[j], i), (t[1], b[j], i), (t[2], a[i], j), (t[3], b[i], j)):
            met = (turn == 0) & ((p >= low[on]) & (p <= high[on])).all(axis=1)
            good[of[i[met & (ring[i] == ring[j])]]] = False
            for k in np.flatnonzero(met & good[of[i]]):
                touches.setdefault(int(of[i[k]]), set()).update(((int(ring[i[k]]), *p[k].tolist()), (int(ring[j[k]]), *p[k].tolist())))
    several = np.flatnonzero(good & (np.bincount(polygon, minlength=len(good)) > 1))
    ends = np.searchsorted(ring, np.arange(len(sizes) + 1))
    for k in several:
        rings = {r: a[ends[r] : ends[r + 1]] for r in range(*np.searchsorted(polygon, [k, k + 1]).tolist())}
        met = touches.get(int(k), set())
        good[k] = _connected(met) and _nested(rings, met)
    return good


def is_valid(rings: list[np.ndarray]) -> bool:
    """Validity of one polygon of (n, 2) arrays: the ring, then its holes."""
    return bool(valid(np.concatenate(rings), np.array([len(r) for r in rings]), np.zeros(len(rings), int))[0])


def _turn(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Sign of the turn from a over b to c, exact: signs that rounding could change are worked out in fractions."""
    left, right = (b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]), (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])
    out = np.sign(left - right)
    for k in np.flatnonzero(np.abs(left - right) < ERROR * (np.abs(left) + np.abs(right))):
        (ax, ay), (bx, by), (cx, cy) = (map(Fraction, p[k].tolist()) for p in (a, b, c))
        exact = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
        out[k] = (exact > 0) - (exact < 0)
    return out


def _meeting(low: np.ndarray, high: np.ndarray, of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sides of one polygon whose boxes meet, once each, in bounded batches: each polygon's sides are swept along the
    axis where fewer of them overlap."""
    sweeps = []
    for axis in (0, 1):
        values, rank = np.unique(np.concatenate([low[:, axis], high[:, axis]]), return_inverse=True)
        first, last = of * len(values) + rank.reshape(2, -1)
        order = np.argsort(first, kind="stable")
        count = np.searchsorted(first[order], last[order], side="right") - np.arange(len(of)) - 1
        sweeps.append((order, count, np.bincount(of[order], weights=count)))
    other = sweeps[1][2] < sweeps[0][2]
    for (order, count, _), chosen in zip(sweeps, (~other, other)):
        count = np.where(chosen[of[order]], count, 0)
        ends = np.cumsum(count)
        for start in range(0, int(ends[-1]), PAIRS):
            pair = np.arange(start, min(start + PAIRS, int(ends[-1])))
            i = np.searchsorted(ends, pair, side="right")
            i, j = order[i], order[i + 1 + pair - (ends[i] - count[i])]
            meet = ((low[i] <= high[j]) & (low[j] <= high[i])).all(axis=1)
            yield i[meet], j[meet]


def _connected(touches: set[tuple[int, float, float]]) -> bool:
    """Whether rings and the points where they touch form no cycle: a cycle cuts the interior in pieces."""
    root: dict[object, object] = {}

    def top(x: object) -> object:
        while x in root:
            x = root[x]
        return x

    for ring, x, y in touches:
        u, v = top(ring), top((x, y))
        if u == v:
            return False
        root[u] = v
    return True


def _nested(rings: dict[int, np.ndarray], touches: set[tuple[int, float, float]]) -> bool:
    """Whether each hole lies inside the first ring and no hole inside another; a point beside the touches stands for a hole."""
    outer, *holes = rings
    boxes = {m: (rings[m].min(axis=0), rings[m].max(axis=0)) for m in holes}
    for k in holes:
        free = next((p for p in rings[k] if (k, *p.tolist()) not in touches), None)
        if free is None or not _inside(free, rings[outer]):
            return False
        for m, (low, high) in boxes.items():
            if m != k and (low <= free).all() and (free <= high).all() and _inside(free, rings[m]):
                return False
    return True


def _inside(p: np.ndarray, ring: np.ndarray) -> bool:
    a, b = ring, np.roll(ring, -1, axis=0)
    spans = (a[:, 1] > p[1]) != (b[:, 1] > p[1])
    a, b = a[spans], b[spans]
    turn = _turn(a, b, np.broadcast_to(p, a.shape))
    return bool(np.count_nonzero(np.where(b[:, 1] > a[:, 1], turn > 0, turn < 0)) % 2)
