"""Sources, statistics, geometry, pixels and pipelines on small fixtures made here."""

import json
import math
import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from terragrid.functions import geometry, labels, pixels
from terragrid.operators import grids, lookups, stats
from terragrid.plans import pipelines
from terragrid.sources import rasters, summary


def wkb(ring, z=False):
    flat = b"".join(struct.pack("<ddd" if z else "<dd", *p, *([9.0] if z else [])) for p in ring)
    return struct.pack("<BIII", 1, 1003 if z else 3, 1, len(ring)) + flat


SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]


def test_polygon_layer(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "a.gpkg")
    con.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    con.execute("INSERT INTO gpkg_geometry_columns VALUES ('shapes', 'geom')")
    con.execute("CREATE TABLE shapes (fid INTEGER PRIMARY KEY, class INTEGER, geom BLOB)")
    head = b"GP\0\1" + struct.pack("<i", 32718)
    multi = struct.pack("<BII", 1, 6, 2) + wkb(SQUARE) + wkb(SQUARE[:-1])
    con.executemany("INSERT INTO shapes VALUES (?, ?, ?)", [(1, 1, head + wkb(SQUARE, z=True)), (2, 3, head + multi), (3, None, None), (4, 2, head + b"\1\1\0\0\0junk")])
    con.commit()
    con.close()
    rows = {r.fid: r for r in rasters.read_polygons(spark, str(tmp_path)).collect()}
    assert [tuple(p) for p in rows[1].polygon_points[0].exterior] == SQUARE and rows[1].srid == 32718
    assert len(rows[2].polygon_points) == 2 and rows[3].polygon_points is None and rows[3].error is None and rows[4].error


def test_tiff_tags(spark, tmp_path):
    tags = [(256, 3, 1, 7), (257, 3, 1, 5), (277, 3, 1, 4), (33550, 12, 3, 200), (33922, 12, 6, 224), (34735, 3, 8, 272)]
    body = b"II" + struct.pack("<HIH", 42, 8, len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags)
    body = body.ljust(200, b"\0") + struct.pack("<3d", 0.5, 0.25, 0) + struct.pack("<6d", 0, 0, 0, 100, 200, 0) + struct.pack("<8H", 1, 1, 0, 1, 3072, 0, 1, 32718)
    (tmp_path / "a.tif").write_bytes(body)
    (tmp_path / "b.tif").write_bytes(b"not a tiff")
    rows = {r.path[-5:]: r for r in rasters.read_tiff_info(spark, str(tmp_path)).collect()}
    a = rows["a.tif"]
    assert (a.width, a.height, a.bands, a.srid, tuple(a.affine), a.error) == (7, 5, 4, 32718, (0.5, 100.0, -0.25, 200.0), None)
    assert rows["b.tif"].width is None and rows["b.tif"].error


def test_images_round_trip(spark, tmp_path):
    v = np.arange(12.0) * 20
    (r,) = spark.createDataFrame([(v.tolist(), 3, 4)], "v array<double>, h int, w int").select(rasters.png(F.col("v"), F.col("h"), F.col("w")).alias("x")).collect()
    (tmp_path / "x.png").write_bytes(bytes(r.x))
    (got,) = rasters.read_images(spark, str(tmp_path), "*.png").collect()
    assert (got.h, got.w, got.v) == (3, 4, v.tolist())


def test_summaries(spark, tmp_path):
    record = {"polygon_index": 1, "class": 1, "bounds": {"minx": 0, "miny": 0, "maxx": 2, "maxy": 2}, "bbox_size_meters": {"width_m": 2, "height_m": 3, "area_m2": 6}, "polygon_points": [{"exterior": [[0, 0], [1, 0], [1, 1]], "interiors": []}], "image_shape": {"height": 8, "width": 9, "channels": 3}, "files": {"ortho_jpeg": "a.jpg"}}
    other = {"geoglyph_id": 7, "class": "?", "filename": "b.jpg", "bbox_size_meters": [4, 5, 20], "polygon_coords": [[0, 0], [2, 2], [0, 2]]}
    for name, doc in (("a", {"total_polygons": 1, "polygons": [record]}), ("b", {"metadata": [other, {}]})):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=2))
    (tmp_path / "c.json").write_text("{ broken")
    rows = {(r.id, r.file): r for r in summary.read_summaries(spark, str(tmp_path)).collect()}
    a, b = rows[1, "a.jpg"], rows[7, "b.jpg"]
    assert (a["class"], a.width_m, a.area_m2, len(a.ring)) == (1, 2.0, 6.0, 3)
    assert (b["class"], b.class_text, b.height_m, len(b.ring)) == (None, "?", 5.0, 3)
    assert rows[None, None].class_text == "unknown" and len(rows) == 3
    with pytest.raises(Exception):
        summary.read_summaries(spark, str(tmp_path), strict=True).collect()


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(5)
    data = {"a": rng.normal(size=501), "b": np.repeat([1.0, 2.0, 9.0], [300, 1, 2]), "c": np.array([4.0]), None: rng.integers(0, 9, 77).astype(float)}
    df = spark.createDataFrame([(k, float(x)) for k, xs in data.items() for x in xs] + [("a", None), ("a", float("nan")), ("d", None)], "g string, x double")
    got = {r.g: r.q for r in stats.exact_quantiles(df, ["g"], "x", (0, 0.25, 0.5, 0.9, 1)).collect()}
    assert got.keys() == data.keys()
    for k, xs in data.items():
        assert got[k] == pytest.approx(np.quantile(xs, (0, 0.25, 0.5, 0.9, 1)).tolist())
    assert stats.exact_quantiles(df.where("false"), ["g"], "x", (0.5,)).collect() == []
    assert stats.exact_quantiles(df, [], "x", (0.5,)).first().n == 501 + 303 + 1 + 77


def test_quantiles_of_large_groups(spark, monkeypatch):
    """Groups beyond one bracket: ties at the quartiles, skewed values, infinities, and columns named like inner ones."""
    rng = np.random.default_rng(3)
    data = {"even": rng.random(9_000), "tied": np.repeat([1.0, 2.0, 3.0], [2_000, 3_000, 2_000]), "long": np.exp(rng.normal(0, 9, 8_000)), "same": np.full(5_000, 7.0), "ends": np.concatenate([np.full(2_500, -np.inf), rng.random(4_000), np.full(2_500, np.inf)])}
    df = spark.createDataFrame([(k, float(x)) for k, xs in data.items() for x in rng.permutation(xs)], "part string, x double").repartition(5)
    probs = (0.0, 0.3, 0.5, 0.501, 0.75, 1.0)
    for small in (stats.SMALL, 2):  # bounds sent to all, and joined by key
        monkeypatch.setattr(stats, "SMALL", small)
        got = {r.part: r for r in stats.exact_quantiles(df, ["part"], "x", probs).collect()}
        assert got.keys() == data.keys()
        for k, xs in data.items():
            assert got[k].n == len(xs)
            inner = [i for i, p in enumerate(probs) if k != "ends" or 0.3 <= p < 0.7]  # between equal infinities lies no number
            assert np.array(got[k].q)[inner] == pytest.approx(np.quantile(xs, probs)[inner], rel=1e-12)
    kept = stats.remove_outliers(df.where("part = 'long'"), ["part"], "x")
    q1, q3 = np.quantile(data["long"], (0.25, 0.75))
    assert kept.count() == int(((data["long"] >= q1 - 1.5 * (q3 - q1)) & (data["long"] <= q3 + 1.5 * (q3 - q1))).sum())


def test_geometry(spark):
    ell = [[0.0, 0.0], [4.0, 0.0], [4.0, 2.0], [2.0, 2.0], [2.0, 4.0], [0.0, 4.0]]
    bow = [[0.0, 0.0], [2.0, 2.0], [2.0, 0.0], [0.0, 2.0]]
    df = spark.createDataFrame([("ell", ell), ("bow", bow), ("none", None)], "k string, ring array<array<double>>")
    L = lambda *x: [F.lit(v) for v in x]
    g = F.col("ring")
    rows = {r.k: r for r in df.select("k", geometry.ring_area(g).alias("area"), geometry.valid_polygon(g).alias("ok"), geometry.overlap_area(g, *L(1, 1, 3, 3)).alias("cut"), geometry.overlap_area(g, *L(9, 9, 10, 10)).alias("off"), geometry.overlaps_at_least(g, *L(1, 1, 3, 3), 0.7).alias("hit")).collect()}
    assert (rows["ell"].area, rows["ell"].ok, rows["ell"].cut, rows["ell"].off, rows["ell"].hit) == (12, True, 3, 0, True)
    assert rows["bow"].ok is False and rows["bow"].hit is False and rows["none"].area is None and rows["none"].hit is False
    pts = spark.createDataFrame([(-75.1, -14.7)], "x double, y double")
    for srid in (32718, 3857):
        there = pts.select(geometry.reproject(F.col("x"), F.col("y"), 4326, srid).alias("p")).select("p.x", "p.y")
        back = there.select(geometry.reproject(F.col("x"), F.col("y"), srid, 4326).alias("p")).first().p
        assert (back.x, back.y) == pytest.approx((-75.1, -14.7), abs=1e-8)
    # a degree of the equator, and of a meridian from the equator, on WGS84
    got = pts.select(geometry.geodesic_metres(*L(0.0, 0.0, 1.0, 0.0)).alias("a"), geometry.geodesic_metres(*L(0.0, 0.0, 0.0, 1.0)).alias("b")).first()
    assert got.a == pytest.approx(6378137 * math.pi / 180, abs=1e-3) and got.b == pytest.approx(110574.389, abs=1e-2)


def test_grids(spark):
    df = spark.createDataFrame([(1, 100, 50), (2, 300, 500)], "image_id int, w int, h int")
    for n in (0, 1, 7):
        assert grids.fixed_grid(df, 64, n).groupBy("image_id").count().where(F.col("count") != n).isEmpty()
    far = grids.crop_windows(grids.fixed_grid(df, 64, None, 60), 64).where("image_id = 1 AND cx = 152").collect()
    assert far and all(r.coverage == 0 for r in far)
    assert grids.sliding_patches(df).where("image_id = 1").isEmpty()
    assert grids.random_centres(df, "image_id", 9).where("cx < 0 OR cx >= w OR cy < 0 OR cy >= h").isEmpty()
    with pytest.raises(ValueError):
        grids.fixed_grid(df, 64, 3, 0)


def test_pixels(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 256, (6, 5)).astype(float)
    df = spark.createDataFrame([(1, x.ravel().tolist(), 6, 5), (2, None, 6, 5)], "k int, v array<double>, h int, w int")
    c = F.col
    for kind in pixels.RESIZERS:
        got = {r.k: r.y for r in df.select("k", pixels.resized(c("v"), c("h"), c("w"), c("h"), c("w"), kind).alias("y")).collect()}
        assert got[2] is None and np.abs(np.array(got[1]) - x.ravel()).max() <= (1e9 if kind == "chebyshev" else 0), kind
    flat = pixels.weights("chebyshev", 6, 9).sum(axis=1)
    assert flat == pytest.approx(np.ones(9))
    mask = F.array(*[F.lit(int(i < 10)) for i in range(30)])
    for kind in ("gaussian", "uniform", "perlin"):
        r = df.select(pixels.noise_fill(c("v"), mask, c("k"), 0.5, kind, w=c("w")).alias("y")).first().y
        assert r[:10] == x.ravel()[:10].tolist() and all(0 <= v <= 255 for v in r) and len(set(r[10:])) > 3
    cut = df.select(pixels.crop(c("v"), c("h"), c("w"), F.lit(-1), F.lit(4), 3).alias("c")).first().c
    assert cut.mask == [0, 1, 1, 0, 1, 1, 0, 0, 0] and cut.v[1:3] == x[4, :2].tolist()


def test_lookups(spark):
    cat = spark.createDataFrame([("Unita", "x"), ("other", None)], "name string, geos_dir string")
    assert lookups.look_up(cat, "UNITA").count() == 1 and lookups.list_catalog(cat).count() == 1
    with pytest.raises(ValueError):
        lookups.look_up(cat, "nowhere")
    a = spark.createDataFrame([("u", "1.png"), ("u", "2.png")], "area string, file string")
    assert lookups.paired(a, a.withColumn("w", F.lit(3))).count() == 2
    with pytest.raises(Exception):
        lookups.paired(a, a.withColumn("w", F.lit(3)).limit(1)).collect()
    names = spark.createDataFrame([("Unita_0001_ortho.jpg",), ("zzz.jpg",), (None,)], "n string")
    assert [r.x for r in names.select(labels.area_of_file(F.col("n")).alias("x")).collect()] == ["unita", "unknown", "unknown"]


def test_spline_weights():
    """Splines reproduce their values, constants and, inside, cubics; the sweep solves the system; a blur keeps constants."""
    for n in (1, 2, 3, 9, 40):
        assert pixels.weights("spline", n, n) == pytest.approx(np.eye(n), abs=1e-12)
        for m in (1, 2, 7, 53):
            assert pixels.weights("spline", n, m).sum(axis=1) == pytest.approx(np.ones(m))
    n, m = 60, 150
    x, at = np.arange(n) / n, ((np.arange(m) + 0.5) * n / m - 0.5) / n
    inner = slice(60, 90)  # far from the mirrored ends
    assert (pixels.weights("spline", n, m) @ (x**3 - x))[inner] == pytest.approx((at**3 - at)[inner], abs=1e-9)
    system = np.diag(np.full(9, 4 / 6)) + np.diag(np.full(8, 1 / 6), 1) + np.diag(np.full(8, 1 / 6), -1)
    system[0, 1] = system[-1, -2] = 2 / 6
    assert system @ pixels._spline_coefficients(np.eye(9)) == pytest.approx(np.eye(9), abs=1e-12)


def test_pipelines(spark):
    rng = np.random.default_rng(2)
    imgs = spark.createDataFrame([(i, rng.integers(0, 256, 900).astype(float).tolist(), 30, 30, "Africa", [[0.0, 0.0], [20.0, 0.0], [20.0, 30.0], [0.0, 30.0]] if i else None) for i in range(2)], "image_id int, v array<double>, h int, w int, area string, ring array<array<double>>")
    for strategy in grids.STRATEGIES:
        got = pipelines.crops(imgs, strategy, n=4, window=10, stride=(8, 8), ring="ring")
        assert 0 < got.count() <= 8
        assert pipelines.crop_pixels(got, imgs, 10, level=0.1).where(F.size("v") != 100).isEmpty()
    assert pipelines.crop_batch(imgs, "fixed", windows=(8, 10), n=3).count() == 2 * 2 * 3 * 6
    scales = spark.createDataFrame([("africa", 0.5)], "area string, scale double")
    small = pipelines.resize(imgs, scales)
    assert small.where((F.col("h") == 15) & (F.size("v") == 225)).count() == 2
    cut = pipelines.patches(imgs, size=12, step=6)
    assert cut.where("image_id = 0 AND NOT accepted").isEmpty() and not cut.where("image_id = 1 AND NOT accepted").isEmpty()
    assert pipelines.augmented(cut, 12).count() == 3 * cut.where("accepted").count()
    assert pipelines.comparison(imgs, 0.5, zoom=8).where(F.size("bicubic") == 225).count() == 2


def test_areas_of_all_prefixes(spark):
    names = ["unita_1", "LLUTA_2", "chug_3", "chugchug_4", "GranLlama_5", "salvador_6", "chugchu_7", "salvador", None]
    df = spark.createDataFrame([(n,) for n in names], "n string").coalesce(1)
    got = [r.a for r in df.select(labels.area_of_file(F.col("n")).alias("a")).collect()]
    assert got == ["unita", "lluta", "chugchug", "chugchug", "granllama", "salvador", "unknown", "unknown", "unknown"]


def test_extraction_moves_rings_to_each_rasters_crs(spark):
    """A square in degrees over a raster in UTM and one in degrees: both windows are the square's own pixels."""
    ring = [[-69.9, -20.0], [-69.898, -20.0], [-69.898, -19.999], [-69.9, -19.999], [-69.9, -20.0]]
    part = "array<struct<exterior: array<array<double>>, interiors: array<array<array<double>>>>>"
    polygons = spark.createDataFrame([(i, 1, [(ring, [])], r) for i, r in enumerate(["utm", "deg", "none"])], f"fid long, class int, polygon_points {part}, raster string")
    x, y = (float(v[0]) for v in geometry._project(np.array([-69.9]), np.array([-19.999]), 32719))
    rasters = spark.createDataFrame([("utm", (0.5, x - 50.0, -0.5, y + 25.0), 32719), ("deg", (1e-5, -69.9, -1e-5, -19.999), 4326), ("none", (1e-5, -69.9, -1e-5, -19.999), None)], "path string, affine struct<a: double, c: double, e: double, f: double>, srid int")
    got = {r.polygon_index: r for r in pipelines.extraction(polygons, rasters, srid=4326).collect()}
    assert abs(got[0].window.col0 - 100) <= 1 and abs(got[0].window.row0 - 50) <= 12
    assert abs(got[0].window.col1 - got[0].window.col0 - 2 * 209) < 6 and got[0].bounds.minx > 180_000
    assert got[1].window == got[2].window and abs(got[1].window.col1 - got[1].window.col0 - 200) <= 1


def test_polygon_crops_test_the_whole_grid(spark):
    """Only the last cell of the grid lies in the polygon: beyond the n-th, yet it is found, as the image's first crop."""
    ring = [[600.0, 600.0], [1000.0, 600.0], [1000.0, 1000.0], [600.0, 1000.0], [600.0, 600.0]]
    df = spark.createDataFrame([(1, 1000, 1000, ring)], "image_id long, h int, w int, ring array<array<double>>")
    got = pipelines.crops(df.withColumn("area", F.lit("unita")), "polygon", n=5, window=200, ring="ring", threshold=0.3, area="area").collect()
    assert [(r.crop_id, r.crop_index, r.x0, r.y0) for r in got] == [("unita_0001_000", 0, 800, 800)]


def test_columns_named_like_inner_ones_pass_through(spark):
    """Operators that add and drop columns of their own leave a user's columns of any name alone."""
    inner = ("_cols", "_rows", "_p", "_n", "_code", "_name", "_area", "_scale", "_key", "_found", "_t", "__p")
    df = spark.range(3).selectExpr("id", "1 AS class", "'Area' AS area", "id AS k", "'a/x_ortho.png' AS path", "800 AS w", "600 AS h", *[f"'{c}' AS {c}" for c in inner])

    def intact(out, kept=inner):
        rows = out.collect()
        assert rows and all(r[c] == c for r in rows for c in kept)
        return rows

    assert len(intact(grids.fixed_grid(df, 256, 6))) == 18
    assert len(intact(grids.fixed_grid(df, 256, 6, 100))) == 18
    assert len(intact(grids.uniform_subsample(df, "class", ["id"], 2))) == 2
    assert len(intact(grids.random_subset(df, "class", ["id"], 2))) == 2
    assert {r.class_name for r in intact(lookups.with_class_names(df, spark.createDataFrame([(1, "one")], "code int, name string")))} == {"one"}
    assert {r.scale for r in intact(lookups.with_scale(df, spark.createDataFrame([("AREA", 0.5)], "area string, scale double")))} == {0.5}
    meta = spark.createDataFrame([("x_metadata.json", 7)], "file string, found int")
    assert {r.found for r in intact(lookups.with_metadata(df, meta))} == {7}
    assert len(intact(lookups.paired(df, df.select("id", "w"), ["id"]))) == 3
