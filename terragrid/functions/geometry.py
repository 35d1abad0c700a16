"""Rings, boxes and affine transforms as Spark expressions; geodesy as small vectorised functions.

A ring is array<array<double>> of (x, y, ...) points, closed or not. Null rings give null. Holes and further parts are not
looked at by the overlap tests.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from terragrid.functions.arrays import let, total, upto
from terragrid.functions.validity import valid_polygon

RING = "array<array<double>>"


def first_ring(polygon_points: Column, polygon: Column, geometry_coordinates: Column, coordinates: Column) -> Column:
    """The exterior ring of the first encoding that a record has; null for none."""
    return F.coalesce(F.get(polygon_points, F.lit(0))["exterior"], polygon, F.get(geometry_coordinates, F.lit(0)), coordinates)


def point_to_pixel(x: Column, y: Column, b: Column, width: Column, height: Column, mode: str = "float") -> Column:
    """struct<x, y> of world coordinates on an image with bounds b (minx, miny, maxx, maxy).

    `float`: a box without extent gives null. `int`: such a side counts as 1, results are truncated. `guarded`: the
    point itself where the box or the image has no extent.
    """
    dx, dy = b["maxx"] - b["minx"], b["maxy"] - b["miny"]
    if mode == "int":
        dx, dy = F.when(dx == 0, 1.0).otherwise(dx), F.when(dy == 0, 1.0).otherwise(dy)
    px, py = (x - b["minx"]) / F.nullif(dx, F.lit(0.0)) * width, (b["maxy"] - y) / F.nullif(dy, F.lit(0.0)) * height
    if mode == "float":
        return F.struct(px.alias("x"), py.alias("y"))
    if mode == "int":
        return F.struct(px.cast("int").alias("x"), py.cast("int").alias("y"))
    if mode == "guarded":
        fit = F.coalesce((dx != 0) & (dy != 0) & (width > 0) & (height > 0), F.lit(False))
        return F.struct(F.when(fit, px).otherwise(x).alias("x"), F.when(fit, py).otherwise(y).alias("y"))
    raise ValueError("mode is float, int or guarded")


def ring_to_pixels(ring: Column, b: Column, width: Column, height: Column, mode: str = "float") -> Column:
    def at(p: Column) -> Column:
        q = point_to_pixel(p[0], p[1], b, width, height, mode)
        return F.array(q["x"].cast("double"), q["y"].cast("double"))

    return F.transform(ring, at)


def ring_area(ring: Column) -> Column:
    """Area by the shoelace rule; 0 for fewer than three points."""

    def cross(p: Column, i: Column) -> Column:
        q = F.coalesce(F.get(ring, i + 1), F.get(ring, F.lit(0)))
        return p[0] * q[1] - q[0] * p[1]

    return F.when(ring.isNotNull(), F.abs(total(F.transform(ring, cross))) / 2)


def ring_bounds(ring: Column) -> Column:
    """struct<minx, miny, maxx, maxy>."""
    xs, ys = F.transform(ring, lambda p: p[0]), F.transform(ring, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def _open(ring: Column) -> Column:
    """The ring without a last point that repeats the first."""
    return F.when((F.size(ring) > 1) & (F.get(ring, F.lit(0)) == F.element_at(ring, -1)), F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)


def clip_to_box(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The ring cut by a box, side by side (points on the box are inside)."""

    def cut(r: Column, axis: int, limit: Column, sign: int) -> Column:
        inside = lambda p: (p[axis] - limit) * sign >= 0

        def side(i: Column) -> Column:
            p, q = F.get(r, i), F.coalesce(F.get(r, i + 1), F.get(r, F.lit(0)))
            t = (limit - p[axis]) / F.nullif(q[axis] - p[axis], F.lit(0.0))
            met = F.array(*[limit if k == axis else p[k] + t * (q[k] - p[k]) for k in (0, 1)])
            none = F.array().cast(RING)
            return F.concat(F.when(inside(p), F.array(F.array(p[0], p[1]))).otherwise(none), F.when(inside(p) != inside(q), F.array(met)).otherwise(none))

        return F.flatten(F.transform(upto(F.size(r)), side))

    out = _open(ring)
    for axis, limit, sign in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        out = let(out, lambda r: cut(r, axis, limit.cast("double"), sign))  # called at once
    return out


def overlap_area(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Area that a ring and a box share: the signed areas between the box's lower side and each side of the ring, cut by the
    box, add up to it. One pass over the points; nothing is clipped."""
    left, low, right, high = (c.cast("double") for c in (x0, y0, x1, y1))
    within = lambda v, a, b: F.least(F.greatest(v, a), b)

    def strip(i: Column) -> Column:
        p, q = F.get(ring, i), F.coalesce(F.get(ring, i + 1), F.get(ring, F.lit(0)))
        slope = (q[1] - p[1]) / F.nullif(q[0] - p[0], F.lit(0.0))
        a, b = within(p[0], left, right), within(q[0], left, right)
        return F.when(a == b, 0.0).otherwise((b - a) * let(F.array(p[1] + slope * (a - p[0]), q[1] + slope * (b - q[0])), height))

    def height(y: Column) -> Column:  # mean height of a side over the box's lower side, cut by the box
        a, b, rise = within(y[0], low, high), within(y[1], low, high), F.abs(y[1] - y[0])
        above = F.greatest(F.greatest(y[0], y[1]) - high, F.lit(0.0)) - F.greatest(F.least(y[0], y[1]) - high, F.lit(0.0))
        cut = (F.abs(b - a) * ((a + b) / 2 - low) + above * (high - low)) / F.nullif(rise, F.lit(0.0))
        return F.when((a == y[0]) & (b == y[1]), (a + b) / 2 - low).otherwise(F.coalesce(cut, a - low))

    area = F.abs(total(F.transform(upto(F.size(ring)), strip)))
    return F.when((right <= left) | (high <= low), 0.0).otherwise(area)


def overlaps_at_least(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column, threshold: float, valid: Column | None = None) -> Column:
    """overlap / window >= threshold; false for invalid rings and windows without area. `valid` may be given where it is
    known, so that a ring with many windows is judged once."""
    size = ((x1 - x0) * (y1 - y0)).cast("double")
    enough = overlap_area(ring, x0, y0, x1, y1) / F.nullif(size, F.lit(0.0)) >= threshold
    return F.coalesce((size > 0) & enough & (valid_polygon(ring) if valid is None else valid), F.lit(False))


def crop_overlaps(ring: Column, cx: Column, cy: Column, window: int, threshold: float) -> Column:
    """overlap / window area > threshold - 1e-9, or the whole box inside for a threshold of 1.

    The box reaches window // 2 to each side, the divisor is window squared: odd windows never reach 1.
    """
    half = window // 2
    area = overlap_area(ring, cx - half, cy - half, cx + half, cy + half)
    if threshold >= 0.9999:
        return F.coalesce(area >= float(4 * half * half) * (1 - 1e-12), F.lit(False))
    return F.coalesce(area / float(window * window) > threshold - 1e-9, F.lit(False))


def coverage_percent(ring: Column, width: Column, height: Column) -> Column:
    """Share of the image that the ring covers, in percent; null for invalid rings."""
    return F.when(valid_polygon(ring), ring_area(ring) / F.nullif((width * height).cast("double"), F.lit(0.0)) * 100)


def padded(b: Column, pad: float = 0.05) -> Column:
    """Bounds widened by `pad` of their extent on each side."""
    dx, dy = (b["maxx"] - b["minx"]) * pad, (b["maxy"] - b["miny"]) * pad
    return F.struct((b["minx"] - dx).alias("minx"), (b["miny"] - dy).alias("miny"), (b["maxx"] + dx).alias("maxx"), (b["maxy"] + dy).alias("maxy"))


def pixel_window(b: Column, t: Column) -> Column:
    """struct<row0, col0, row1, col1> of world bounds under the affine t (a, c, e, f; no rotation), floored."""
    col, row = lambda x: F.floor((x - t["c"]) / t["a"]), lambda y: F.floor((y - t["f"]) / t["e"])
    return F.struct(row(b["maxy"]).alias("row0"), col(b["minx"]).alias("col0"), row(b["miny"]).alias("row1"), col(b["maxx"]).alias("col1"))


def window_transform(t: Column, row0: Column, col0: Column) -> Column:
    """The affine of a window that starts at row0, col0."""
    return F.struct(t["a"].alias("a"), (t["c"] + col0 * t["a"]).alias("c"), t["e"].alias("e"), (t["f"] + row0 * t["e"]).alias("f"))


def rescaled(t: Column, sx: Column, sy: Column) -> Column:
    """The affine of the same area with sx, sy times the pixels."""
    return F.struct((t["a"] / sx).alias("a"), t["c"].alias("c"), (t["e"] / sy).alias("e"), t["f"].alias("f"))


def raster_extent(t: Column, width: Column, height: Column) -> Column:
    """struct<pixel_w, pixel_h, geo_w, geo_h, area>."""
    pw, ph = F.abs(t["a"]), F.abs(t["e"])
    return F.struct(pw.alias("pixel_w"), ph.alias("pixel_h"), (pw * width).alias("geo_w"), (ph * height).alias("geo_h"), (pw * width * ph * height).alias("area"))


def tile_ids(b: Column, size: float) -> Column:
    """array<struct<tx, ty>> of the tiles of side `size` that bounds touch: the key of an equi-join with a tile table."""
    axis = lambda low, high: F.sequence(F.floor(b[low] / size), F.floor(b[high] / size))
    return F.flatten(F.transform(axis("minx", "maxx"), lambda x: F.transform(axis("miny", "maxy"), lambda y: F.struct(x.alias("tx"), y.alias("ty")))))


# WGS84: equatorial radius and flattening (fixed values of the public standard).
_A, _F = 6378137.0, 1 / 298.257223563


def _geodesic(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> np.ndarray:
    """Metres by Vincenty's inverse formula (1975), vectorised; NaN where it does not converge."""
    b = _A * (1 - _F)
    u1, u2 = (np.arctan((1 - _F) * np.tan(np.radians(x))) for x in (lat1, lat2))
    gap = np.radians(lon2 - lon1)
    lam, delta = gap.copy(), np.full_like(gap, np.inf)
    with np.errstate(all="ignore"):
        for _ in range(100):
            s = np.hypot(np.cos(u2) * np.sin(lam), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam))
            c = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
            sigma = np.arctan2(s, c)
            az = np.where(s > 0, np.cos(u1) * np.cos(u2) * np.sin(lam) / s, 0.0)
            cos2 = 1 - az**2
            mid = np.where(cos2 > 1e-15, c - 2 * np.sin(u1) * np.sin(u2) / cos2, 0.0)
            k = _F / 16 * cos2 * (4 + _F * (4 - 3 * cos2))
            new = gap + (1 - k) * _F * az * (sigma + k * s * (mid + k * c * (2 * mid**2 - 1)))
            delta, lam = np.abs(new - lam), new
            if not (delta > 1e-13).any():
                break
        w = cos2 * (_A**2 - b**2) / b**2
        big = 1 + w / 16384 * (4096 + w * (-768 + w * (320 - 175 * w)))
        small = w / 1024 * (256 + w * (-128 + w * (74 - 47 * w)))
        d = small * s * (mid + small / 4 * (c * (2 * mid**2 - 1) - small / 6 * mid * (4 * s**2 - 3) * (4 * mid**2 - 3)))
        return np.where(delta <= 1e-9, b * big * (sigma - d), np.nan)


def geodesic_metres(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Length of the shortest line on the WGS84 ellipsoid between two points in degrees."""

    @F.pandas_udf("double")
    def metres(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.Series:
        return pd.Series(_geodesic(*(x.to_numpy(float) for x in (lon1, lat1, lon2, lat2))))

    return metres(lon1, lat1, lon2, lat2)


def box_metres(b: Column) -> Column:
    """struct<width_m, height_m, area_m2> of bounds in degrees: along the lower and the left side; area is their product."""
    w = geodesic_metres(b["minx"], b["miny"], b["maxx"], b["miny"])
    h = geodesic_metres(b["minx"], b["miny"], b["minx"], b["maxy"])
    return F.struct(w.alias("width_m"), h.alias("height_m"), (w * h).alias("area_m2"))


def box_metres_in(b: Column, srid: Column) -> Column:
    """struct<width_m, height_m, area_m2> of bounds in the EPSG code `srid` (null: degrees): three corners are moved to degrees,
    the width runs along the lower left corner's latitude, the height along its longitude. Codes without support give null."""

    @F.pandas_udf("width_m double, height_m double, area_m2 double")
    def run(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series, srid: pd.Series) -> pd.DataFrame:
        out = np.full((len(x0), 3), np.nan)
        box = np.stack([v.to_numpy(float) for v in (x0, y0, x1, y1)])
        codes = srid.fillna(4326).astype(int).to_numpy()
        for code in np.unique(codes):
            at = codes == code
            if not supported(int(code)):
                continue
            (a, c, d), (e, f, g) = zip(*(_unproject(box[i, at], box[j, at], int(code)) for i, j in ((0, 1), (2, 1), (0, 3))))
            w, h = np.abs(_geodesic(a, e, c, e)), np.abs(_geodesic(a, e, a, g))
            out[at] = np.stack([w, h, w * h], axis=1)
        return pd.DataFrame(out, columns=["width_m", "height_m", "area_m2"])

    m = run(b["minx"], b["miny"], b["maxx"], b["maxy"], srid.cast("int"))
    return F.when(F.isnan(m["width_m"]), None).otherwise(m)


def supported(srid: int) -> bool:
    """Whether coordinates of an EPSG code can be moved: 4326, 3857 and the WGS84 UTM zones."""
    return srid in (4326, 3857) or 32601 <= srid <= 32660 or 32701 <= srid <= 32760


def _utm(srid: int) -> tuple[float, float]:
    """(central meridian in degrees, false northing) of a UTM zone."""
    if not (32601 <= srid <= 32660 or 32701 <= srid <= 32760):
        raise ValueError(f"EPSG:{srid} is not supported: 4326, 3857 and the WGS84 UTM zones are")
    return 6.0 * (srid % 100) - 183, 0.0 if srid < 32700 else 1e7


_N = _F / (2 - _F)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# Krueger's series to the third order in n (public formula): forward, inverse, and latitude from conformal latitude.
_FORWARD = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_INVERSE = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_LATITUDE = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def _project(lon: np.ndarray, lat: np.ndarray, srid: int) -> tuple[np.ndarray, np.ndarray]:
    """Degrees to the plane of `srid`."""
    if srid == 4326:
        return lon, lat
    if srid == 3857:
        return _A * np.radians(lon), _A * np.log(np.tan(np.pi / 4 + np.radians(lat) / 2))
    meridian, north = _utm(srid)
    e = 2 * np.sqrt(_N) / (1 + _N)
    s, gap = np.sin(np.radians(lat)), np.radians(lon - meridian)
    t = np.sinh(np.arctanh(s) - e * np.arctanh(e * s))
    xi, eta = np.arctan2(t, np.cos(gap)), np.arctanh(np.sin(gap) / np.hypot(1, t))
    x = eta + sum(a * np.cos(2 * (j + 1) * xi) * np.sinh(2 * (j + 1) * eta) for j, a in enumerate(_FORWARD))
    y = xi + sum(a * np.sin(2 * (j + 1) * xi) * np.cosh(2 * (j + 1) * eta) for j, a in enumerate(_FORWARD))
    return 500_000 + 0.9996 * _RADIUS * x, north + 0.9996 * _RADIUS * y


def _unproject(x: np.ndarray, y: np.ndarray, srid: int) -> tuple[np.ndarray, np.ndarray]:
    """The plane of `srid` to degrees."""
    if srid == 4326:
        return x, y
    if srid == 3857:
        return np.degrees(x / _A), np.degrees(2 * np.arctan(np.exp(y / _A)) - np.pi / 2)
    meridian, north = _utm(srid)
    xi, eta = (y - north) / (0.9996 * _RADIUS), (x - 500_000) / (0.9996 * _RADIUS)
    xi_ = xi - sum(b * np.sin(2 * (j + 1) * xi) * np.cosh(2 * (j + 1) * eta) for j, b in enumerate(_INVERSE))
    eta_ = eta - sum(b * np.cos(2 * (j + 1) * xi) * np.sinh(2 * (j + 1) * eta) for j, b in enumerate(_INVERSE))
    chi = np.arcsin(np.sin(xi_) / np.cosh(eta_))
    lat = chi + sum(d * np.sin(2 * (j + 1) * chi) for j, d in enumerate(_LATITUDE))
    return meridian + np.degrees(np.arctan2(np.sinh(eta_), np.cos(xi_))), np.degrees(lat)


def reproject(x: Column, y: Column, source: int, target: int) -> Column:
    """struct<x, y> in the EPSG code `target`."""
    for srid in (source, target):
        if srid not in (4326, 3857):
            _utm(srid)

    @F.pandas_udf("x double, y double")
    def move(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        lon, lat = _unproject(x.to_numpy(float), y.to_numpy(float), source)
        return pd.DataFrame(dict(zip("xy", _project(lon, lat, target))))

    return move(x, y)


def reproject_ring(ring: Column, source: int, target: int | Column) -> Column:
    """The ring in the EPSG code `target`, which may be a column (null: the ring as it is); Arrow batches of rings."""
    if isinstance(target, int) and source == target:
        return ring
    for srid in (source, target):
        if isinstance(srid, int) and srid not in (4326, 3857):
            _utm(srid)

    @F.pandas_udf(RING)
    def move(rings: pd.Series, targets: pd.Series) -> pd.Series:
        def one(r: Sequence[Sequence[float]] | None, to: float | None) -> list[list[float]] | None:
            if r is None or not len(r):
                return None if r is None else []
            p = np.array([q[:2] for q in r], float)
            if pd.isna(to) or int(to) == source:
                return p.tolist()
            return np.stack(_project(*_unproject(p[:, 0], p[:, 1], source), int(to)), axis=1).tolist()

        return pd.Series([one(r, to) for r, to in zip(rings, targets)], dtype=object)

    return move(ring, F.lit(target) if isinstance(target, int) else target.cast("int"))


PARTS = "array<struct<exterior: array<array<double>>, interiors: array<array<array<double>>>>>"


def reproject_parts(parts: Column, source: Column, target: Column) -> Column:
    """Polygon parts in the EPSG code `target`; as they are where a code is null or both are equal, null without support.

    All points of a batch are moved together, code by code. Parts go to Python and back as JSON, which keeps doubles exactly.
    """

    @F.pandas_udf("string")
    def move(parts: pd.Series, source: pd.Series, target: pd.Series) -> pd.Series:
        rows = [None if p is None else json.loads(p) for p in parts]
        rings, pair = [], []
        for row, a, b in zip(rows, source, target):
            for p in row or ():
                for r in (p.get("exterior"), *(p.get("interiors") or ())):
                    rings.append(np.array([q[:2] for q in r or ()], float).reshape(-1, 2))
                    pair.append((0, 0) if pd.isna(a) or pd.isna(b) or a == b else (int(a), int(b)))
        ends = np.cumsum([0, *map(len, rings)])
        points = np.concatenate(rings) if rings else np.zeros((0, 2))
        of = np.repeat(np.arange(len(rings)), np.diff(ends))
        for a, b in set(pair) - {(0, 0)}:
            at = np.array([x == (a, b) for x in pair])[of]
            points[at] = np.stack(_project(*_unproject(points[at, 0], points[at, 1], a), b), axis=1) if supported(a) and supported(b) else np.nan
        moved = iter([points[lo:hi] for lo, hi in zip(ends, ends[1:])])
        out = []
        for row in rows:
            new = None if row is None else [{"exterior": next(moved).tolist(), "interiors": [next(moved).tolist() for _ in p.get("interiors") or ()]} for p in row]
            lost = new is not None and any(np.isnan(q).any() for p in new for r in (p["exterior"], *p["interiors"]) for q in r)
            out.append(None if new is None or lost else json.dumps(new))
        return pd.Series(out, dtype=object)

    return F.from_json(move(F.to_json(parts), source.cast("int"), target.cast("int")), PARTS)
