"""Polygons extracted from GeoTIFF mosaics, their records and files, patches and georeferenced resizing."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from terragrid.functions import geometry, packed
from terragrid.plans import extraction, pipelines
from terragrid.sources import files, geotiff
from tests.test_geotiff import image, packed as raw

AFFINE = {"a": 0.5, "c": 400_000.0, "e": -0.5, "f": 7_800_000.0}
POLYGONS = f"fid long, class int, polygon_points {geometry.PARTS}, srid int, raster string"


def box(c0, r0, c1, r1):
    """A ring around whole pixels."""
    x, y = lambda c: AFFINE["c"] + c * AFFINE["a"], lambda r: AFFINE["f"] + r * AFFINE["e"]
    return [[x(c0), y(r0), 5.0], [x(c1), y(r0), 5.0], [x(c1), y(r1), 5.0], [x(c0), y(r1), 5.0], [x(c0), y(r0), 5.0]]


@pytest.fixture(scope="module")
def mosaic(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("mosaic")
    x = image(90, 120, 3, "uint8", 7)
    (path / "a.tif").write_bytes(geotiff.encoded(raw(x), 90, 120, 3, affine=AFFINE, srid=32719, tile=32, predictor=2))
    name = f"file:{path}/a.tif"
    inner = box(40, 40, 44, 44)
    rows = [
        (1, 1, [(box(10, 20, 50, 70), [])], 32719, name),
        (2, 2, [(box(30, 30, 60, 60), [inner]), (box(70, 5, 80, 35), [])], 32719, name),
        (3, 1, [(box(100, 80, 150, 120), [])], 32719, name),  # over the edge
        (4, 1, [(box(500, 500, 510, 510), [])], 32719, name),  # outside
        (5, 1, None, 32719, name),
        (6, 3, [(box(0, 0, 5, 5), [])], 32719, "file:/nowhere.tif"),
    ]
    return path, x, spark.createDataFrame(rows, POLYGONS)


def test_records_and_pixels(spark, mosaic):
    path, x, polygons = mosaic
    got = {r.record.polygon_index: r for r in extraction.extracted(spark, polygons, str(path)).collect()}
    assert sorted(got) == [1, 2, 3]
    for i, (r0, r1, c0, c1) in {1: (20, 70, 10, 50), 2: (5, 60, 30, 80), 3: (80, 90, 100, 120)}.items():
        r = got[i]
        want = x[r0:r1, c0:c1]
        assert (np.frombuffer(r.image.data, np.uint8).reshape(want.shape) == want).all()
        assert r.record.image_shape.asDict() == {"height": want.shape[0], "width": want.shape[1], "channels": 3}
        assert r.image.affine.c == AFFINE["c"] + c0 * 0.5 and r.record.crs == "EPSG:32719" and r.padded.h >= r.image.h
    assert got[1].record.files.asDict() == {"ortho_tif": "geoglif_0001_ortho.tif", "ortho_jpeg": "geoglif_0001_ortho.png", "overlay_jpeg": "geoglif_0001_overlay.png"}
    size = got[1].record.bbox_size_meters
    assert abs(size.width_m - 20) < 0.1 and abs(size.height_m - 25) < 0.1 and abs(size.area_m2 - size.width_m * size.height_m) < 1e-9
    assert len(got[2].record.polygon_points) == 2 and len(got[2].record.polygon_points[0].interiors) == 1
    assert [r.record.polygon_index for r in extraction.extracted(spark, polygons, str(path), class_code=1, limit=2).collect()] == [1]


def test_polygons_in_degrees_are_moved(spark, mosaic):
    path, x, polygons = mosaic
    ring = np.array(box(10, 20, 50, 70))[:, :2]
    lon, lat = geometry._unproject(ring[:, 0], ring[:, 1], 32719)
    name = polygons.first().raster
    rows = [(1, 1, [(np.stack([lon, lat], 1).tolist(), [])], 4326, name), (2, 1, [(ring.tolist(), [])], 2154, name)]
    got = extraction.extracted(spark, spark.createDataFrame(rows, POLYGONS), str(path)).collect()
    assert len(got) == 1 and abs(got[0].image.h - 50) <= 1 and abs(got[0].image.w - 40) <= 1


def test_files_are_written_and_read_back(spark, mosaic, tmp_path):
    path, x, polygons = mosaic
    rows = extraction.extracted(spark, polygons, str(path))
    out = tmp_path / "out"
    assert extraction.write_extraction(rows, str(out)) == (12, 0)
    assert sorted(p.name for p in out.glob("geoglif_0001*")) == [f"geoglif_0001_{k}" for k in ("metadata.json", "ortho.png", "ortho.tif", "overlay.png")]
    meta = json.loads((out / "geoglif_0001_metadata.json").read_text())
    assert meta["polygon_index"] == 1 and meta["image_shape"] == {"height": 50, "width": 40, "channels": 3} and set(meta["bounds"]) == {"minx", "miny", "maxx", "maxy"}
    blocks = geotiff.read_blocks(geotiff.read_index(spark, str(out), "geoglif_0001*.tif")).collect()
    assert (np.concatenate([np.frombuffer(b.data, np.uint8).reshape(b.h, b.w, 3) for b in sorted(blocks, key=lambda b: b.row0)]) == x[20:70, 10:50]).all()
    heads = geotiff.read_headers(spark, str(out)).collect()
    assert len(heads) == 3 and all(h.srid == 32719 for h in heads)
    over = spark.read.format("image").load(str(out / "geoglif_0001_overlay.png")).select("image.*").first()
    pixels = np.frombuffer(over.data, np.uint8).reshape(over.height, over.width, 3)[:, :, ::-1]
    assert ((pixels == packed.YELLOW).all(axis=2)).sum() > 2 * (50 + 40)
    from terragrid.sources import summary

    records = summary.read_records(spark, str(out)).where("id = 1").first()
    assert records.width_m == meta["bbox_size_meters"]["width_m"] and len(records.ring) == 5
    listed = spark.createDataFrame([(1, 1, {"a": "geoglif_0001_ortho.tif", "b": "missing.png"}), (2, 2, {"a": "geoglif_0002_ortho.tif"})], "polygon_index long, class int, files map<string, string>")
    assert extraction.copy_class(listed, str(out), str(tmp_path / "geos")) == (2, 1)
    assert sorted(p.name for p in (tmp_path / "geos").glob("geo*")) == ["geoglif_0001_metadata.json", "geoglif_0001_ortho.tif"]


def test_resized_with_georeference(spark, mosaic, tmp_path):
    path, x, _ = mosaic
    one = extraction.extracted(spark, mosaic[2].where("fid = 1"), str(path)).select("image.*")
    assert extraction.write_resized(one, str(tmp_path / "small"), F.lit("unita/x_ortho.tif"), 0.5) == (1, 0)
    head = geotiff.read_headers(spark, str(tmp_path / "small")).first()
    assert (head.height, head.width, head.srid) == (25, 20, 32719) and head.affine.asDict() == {"a": 1.0, "c": AFFINE["c"] + 5, "e": -1.0, "f": AFFINE["f"] - 10}


def test_patches_are_routed_and_counted(spark, tmp_path):
    x = image(60, 70, 3, "uint8", 9)
    ring = [[0.0, 0.0], [40.0, 0.0], [40.0, 60.0], [0.0, 60.0]]
    rows = [("unita/g1", bytearray(raw(x)), 60, 70, 3, ring), ("unita/g2", bytearray(raw(x[:10, :10])), 10, 10, 3, None)]
    df = spark.createDataFrame(rows, "base string, data binary, h int, w int, bands int, ring array<array<double>>")
    saved, skipped = extraction.write_patches(df, str(tmp_path / "p"), size=20, step=20, threshold=0.8)
    assert (saved, skipped) == (6, 3)
    root = tmp_path / "p" / "unita"
    assert len(list((root / "g1").glob("patch_*.png"))) == 6 and sorted(p.name for p in (root / "g1" / "rejected").iterdir()) == ["patch_000_002.png", "patch_001_002.png", "patch_002_002.png"]
    assert (root / "g1" / "g1_original.png").exists() and (root / "g2" / "g2_original.png").exists()
    r = spark.read.format("image").load(str(root / "g1" / "patch_001_000.png")).select("image.data").first()
    assert (np.frombuffer(r.data, np.uint8).reshape(20, 20, 3)[:, :, ::-1] == x[20:40, :20]).all()


def test_polygon_crops_without_a_ring_take_the_first_cells(spark):
    df = spark.createDataFrame([(1, 1000, 1000, None), (2, 1000, 1000, [[0.0, 0.0], [1000.0, 0.0], [1000.0, 1000.0], [0.0, 1000.0]])], "image_id long, h int, w int, ring array<array<double>>")
    for stride in (None, 100):
        got = {}
        for r in pipelines.crops(df, "polygon", n=7, window=200, stride=stride, ring="ring", threshold=0.3).collect():
            got.setdefault(r.source_image_id, []).append(r.crop_index)
        assert sorted(got[1]) == list(range(7)) and len(got[2]) == 7
