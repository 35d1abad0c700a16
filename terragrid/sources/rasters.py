"""Images and polygon layers as tables: Spark lists and reads the files, small helpers decode one file's bytes.

Images keep one row a file; polygons one row a feature. Files that can't be decoded give a row with nulls and an error
text (`errors`), so that one bad file doesn't end a job.
"""

from __future__ import annotations

import sqlite3
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the public TIFF and GeoTIFF standards: tags, and bytes of each field type.
TAGS = {256: "width", 257: "height", 277: "bands", 33550: "scale", 33922: "tie", 34735: "keys"}
FIELD_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 12: 8}
#: GeoTIFF keys that hold an EPSG code: projected, geographic.
EPSG_KEYS = (3072, 2048)


def read_images(spark: SparkSession, path: str | list[str], pattern: str = "*") -> DataFrame:
    """path, h, w, n_bands, v array<double> (luma): JPEG, PNG, GIF, BMP and 8-bit TIFF files, by Spark's image source."""
    raw = spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)

    @F.pandas_udf("array<double>")
    def gray(data: pd.Series, n: pd.Series) -> pd.Series:
        def one(x: bytes, k: int) -> np.ndarray:
            p = np.frombuffer(x, np.uint8).reshape(-1, k).astype(np.int64)
            b, g, r = (p[:, i] for i in ((0, 0, 0) if k == 1 else (0, 1, 2)))
            return ((r * 19595 + g * 38470 + b * 7471 + 32768) >> 16).astype(float)

        return pd.Series([one(x, k) for x, k in zip(data, n)])

    i = F.col("image")
    return raw.select(i["origin"].alias("path"), i["height"].alias("h"), i["width"].alias("w"), i["nChannels"].alias("n_bands"), gray(i["data"], i["nChannels"]).alias("v"))


def tiff_tags(data: bytes) -> dict[str, object]:
    """width, height, bands, affine (a, c, e, f) and srid of a TIFF's first image; what it lacks is absent."""
    end = {b"II": "<", b"MM": ">"}[data[:2]]
    if struct.unpack_from(end + "H", data, 2)[0] != 42:
        raise ValueError("not a plain TIFF")
    at = struct.unpack_from(end + "I", data, 4)[0]
    got: dict[str, tuple] = {}
    for i in range(struct.unpack_from(end + "H", data, at)[0]):
        tag, kind, count = struct.unpack_from(end + "HHI", data, at + 2 + 12 * i)
        if tag in TAGS and kind in FIELD_BYTES:
            place = at + 10 + 12 * i
            if FIELD_BYTES[kind] * count > 4:
                place = struct.unpack_from(end + "I", data, place)[0]
            code = {1: "B", 2: "B", 3: "H", 4: "I", 5: "II", 12: "d"}[kind]
            got[TAGS[tag]] = struct.unpack_from(end + code * count, data, place)
    out: dict[str, object] = {k: int(got[k][0]) for k in ("width", "height", "bands") if k in got}
    if "scale" in got and "tie" in got:
        (sx, sy, _), (i, j, _, x, y, _) = got["scale"], got["tie"][:6]
        out |= {"a": sx, "c": x - i * sx, "e": -sy, "f": y + j * sy}
    keys = got.get("keys", ())
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    for k in EPSG_KEYS:
        if k in codes:
            out.setdefault("srid", int(codes[k]))
    return out


def read_tiff_info(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, width, height, bands, affine struct<a, c, e, f>, srid, error of GeoTIFF files."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.{tif,tiff}").option("recursiveFileLookup", True).load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["width", "height", "bands", "a", "c", "e", "f", "srid"]
        for batch in batches:
            rows = []
            for p, data in zip(batch["path"], batch["content"]):
                try:
                    rows.append({"path": p, "error": None} | tiff_tags(data))
                except (KeyError, ValueError, struct.error) as e:
                    rows.append({"path": p, "error": repr(e)})
            out = pd.DataFrame(rows, columns=["path", *names, "error"])
            yield out.astype({c: "Int64" for c in ("width", "height", "bands", "srid")})

    flat = raw.select("path", "content").mapInPandas(run, "path string, width long, height long, bands long, a double, c double, e double, f double, srid long, error string")
    return flat.select("path", "width", "height", "bands", F.when(F.col("a").isNotNull(), F.struct("a", "c", "e", "f")).alias("affine"), "srid", "error")


def _wkb(data: bytes, at: int = 0) -> tuple[list[dict], int]:
    """(parts with exterior and interiors, place after) of a polygon or multipolygon; further dimensions are dropped."""
    end = "<" if data[at] else ">"
    kind = struct.unpack_from(end + "I", data, at + 1)[0]
    dims = 2 + (bool(kind & 0x80000000) or (kind & 0xFFFF) // 1000 in (1, 3)) + (bool(kind & 0x40000000) or (kind & 0xFFFF) // 1000 in (2, 3))
    base, at = (kind & 0xFFFF) % 1000, at + (9 if kind & 0x20000000 else 5)
    n = struct.unpack_from(end + "I", data, at)[0]
    at += 4
    if base == 6:
        parts = []
        for _ in range(n):
            more, at = _wkb(data, at)
            parts += more
        return parts, at
    if base != 3:
        raise ValueError(f"geometry type {base} is not a polygon")
    rings = []
    for _ in range(n):
        m = struct.unpack_from(end + "I", data, at)[0]
        xy = np.frombuffer(data, end + "f8", m * dims, at + 4).reshape(m, dims)[:, :2]
        rings.append(xy.tolist())
        at += 4 + 8 * m * dims
    return [{"exterior": rings[0] if rings else [], "interiors": rings[1:]}], at


def polygon_parts(blob: bytes) -> tuple[list[dict], int | None]:
    """(parts, srid) of WKB, with or without a GeoPackage header."""
    if blob[:2] != b"GP":
        return _wkb(blob)[0], None
    flags = blob[3]
    srid = struct.unpack_from("<i" if flags & 1 else ">i", blob, 4)[0]
    return _wkb(blob, 8 + (0, 32, 48, 48, 64)[flags >> 1 & 7])[0], srid


def read_polygons(spark: SparkSession, path: str | list[str], class_col: str = "class") -> DataFrame:
    """path, layer, fid, class, polygon_points, srid, error of the features of GeoPackage files; a task reads one file."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.gpkg").option("recursiveFileLookup", True).load(path)
    part = "array<struct<exterior: array<array<double>>, interiors: array<array<array<double>>>>>"
    schema = f"path string, layer string, fid long, class int, polygon_points {part}, srid int, error string"

    def features(p: str, data: bytes) -> Iterator[tuple]:
        con = sqlite3.connect(":memory:")
        con.deserialize(data)
        for layer, geom in con.execute("SELECT table_name, column_name FROM gpkg_geometry_columns ORDER BY 1").fetchall():
            q = lambda x: '"' + x.replace('"', '""') + '"'
            named = [r[1] for r in con.execute(f"PRAGMA table_info({q(layer)})")]
            for fid, code, blob in con.execute(f"SELECT rowid, {q(class_col) if class_col in named else 'NULL'}, {q(geom)} FROM {q(layer)} ORDER BY rowid"):
                try:
                    parts, srid = polygon_parts(blob) if blob is not None else (None, None)
                    yield p, layer, fid, code, parts, srid, None
                except (ValueError, struct.error) as e:
                    yield p, layer, fid, code, None, None, repr(e)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "layer", "fid", "class", "polygon_points", "srid", "error"]
        for batch in batches:
            for p, data in zip(batch["path"], batch["content"]):
                try:
                    rows = list(features(p, data))
                except sqlite3.Error as e:
                    rows = [(p, None, None, None, None, None, repr(e))]
                yield pd.DataFrame(rows, columns=names).astype({"fid": "Int64", "class": "Int64", "srid": "Int64"})

    return raw.select("path", "content").mapInPandas(run, schema)


def png(v: Column, h: Column, w: Column) -> Column:
    """8-bit grey PNG files of packed pixels, as a binary column."""

    @F.pandas_udf("binary")
    def run(v: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        def chunk(kind: bytes, body: bytes) -> bytes:
            return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

        def one(x: np.ndarray, a: int, b: int) -> bytes:
            rows = np.zeros((a, b + 1), np.uint8)
            rows[:, 1:] = np.clip(np.rint(np.asarray(x, float)), 0, 255).reshape(a, b)
            return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", b, a, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")

        return pd.Series([None if x is None else one(x, int(a), int(b)) for x, a, b in zip(v, h, w)])

    return run(v.cast("array<double>"), h, w)
