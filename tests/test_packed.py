"""Packed colour pixels against numpy, rings against fixed pixels, and the sink of loose files."""

import colorsys
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from terragrid.functions import packed, pixels
from terragrid.sources import files

SCHEMA = "id int, data binary, h int, w int, bands int"
AT = ["data", "h", "w", "bands"]


def frame(spark, *images):
    return spark.createDataFrame([(i, None if x is None else bytearray(x.tobytes()), *(x.shape if x is not None else (1, 1, 1))) for i, x in enumerate(images)], SCHEMA)


def back(df, column, shape=None):
    return [None if r[0] is None else np.frombuffer(r[0], np.uint8).reshape(shape or -1) for r in df.orderBy("id").select(column).collect()]


def image(h=9, w=12, n=3, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (h, w, n)).astype(np.uint8)


def test_bands_and_luma(spark):
    x, y = image(), image(n=1, seed=1)
    df = frame(spark, x, y, image(n=4), None)
    a, b, c, d = back(df, packed.rgb(*AT))
    assert (a.reshape(9, 12, 3) == x).all() and (b.reshape(9, 12, 3) == y).all() and (c.reshape(9, 12, 3) == image(n=4)[:, :, :3]).all() and d is None
    g = back(df, packed.gray(*AT))[0].reshape(9, 12)
    assert (g == (x.astype(int) @ [19595, 38470, 7471] + 32768) // 65536).all()
    assert (back(df, packed.rgb(*AT, bgr=True))[0].reshape(9, 12, 3) == x[:, :, ::-1]).all()
    assert [r[0] for r in df.orderBy("id").limit(1).select(packed.to_array(F.col("data"))).collect()] == [x.ravel().tolist()]


@pytest.mark.parametrize("kind", ["chebyshev", "bilinear", "bicubic"])
def test_resized_is_that_of_each_band(spark, kind):
    x = image()
    got = back(frame(spark, x, None), packed.resized(*AT, F.lit(5), F.lit(7), kind), (5, 7, 3))
    one = frame(spark, *[x[:, :, [i]] for i in range(3)])
    want = one.orderBy("id").select(pixels.resized(packed.to_array(F.col("data")), F.col("h"), F.col("w"), F.lit(5), F.lit(7), kind)).collect()
    assert got[1] is None and all((got[0][:, :, i].ravel() == np.array(want[i][0])).all() for i in range(3))
    assert back(frame(spark, x), packed.resized(*AT, F.lit(0), F.lit(7), kind)) == [None]


def test_crops_and_noise(spark):
    x = image()
    df = frame(spark, x, None).withColumn("c", packed.crop(*AT, F.lit(-2), F.lit(5), 6))
    got, mask = back(df, "c.data")[0].reshape(6, 6, 3), back(df, "c.mask")[0].reshape(6, 6)
    assert (got[:4, 2:] == x[5:9, :4]).all() and mask.sum() == 16 and (got[mask == 0] == 0).all() and back(df, "c.data")[1] is None
    cut = df.where("id = 0").select("id", "c.data", F.lit(6).alias("h"), F.lit(6).alias("w"), "bands", "c.mask")
    fill = lambda **k: back(cut, packed.noise_fill(*AT, F.col("mask"), F.col("id"), **k))[0].reshape(6, 6, 3)
    mean = x[5:9, :4].reshape(-1, 3).mean(axis=0)
    for kind in ("gaussian", "uniform", "perlin"):
        assert (fill(level=0.0, kind=kind)[mask == 0] == np.trunc(mean)).all()
        a = fill(level=0.7, kind=kind)
        assert (a == fill(level=0.7, kind=kind)).all() and (a[mask == 1] == got[mask == 1]).all() and len(np.unique(a[mask == 0])) > 5
        assert (a != fill(level=0.7, kind=kind, seed=1)).any()
    with pytest.raises(ValueError):
        packed.noise_fill(*AT, F.col("mask"), F.col("id"), kind="other")


def test_hues_are_those_of_the_standard_library():
    x = image(6, 7) / 255
    h, s, v = packed._to_hsv(x)
    for i in range(6):
        for j in range(7):
            assert np.allclose((h[i, j], s[i, j], v[i, j]), colorsys.rgb_to_hsv(*x[i, j]))
    assert np.allclose(packed._to_rgb(h, s, v), x)


def test_augmented(spark):
    x = image(40, 30)
    same = packed.augmented(x, 5, 64, turn=0, shift=0, jitter=0, hue=0)
    assert same.shape == (64, 64, 3)  # mirrored where the image is smaller
    whole = packed.augmented(x, 5, 30, turn=0, shift=0, jitter=0, hue=0)
    rows = [x[t : t + 30][a][:, b] for t in range(11) for a in (slice(None), slice(None, None, -1)) for b in (slice(None), slice(None, None, -1))]
    assert any((whole == r).all() for r in rows)
    df = frame(spark, x, None, image(40, 30, 1))
    a, n, g = (back(df, packed.augment(*AT, F.col("id"), F.lit(1), size=32))[i] for i in range(3))
    assert n is None and len(a) == 32 * 32 * 3 and len(g) == 32 * 32
    assert (a == back(df, packed.augment(*AT, F.col("id"), F.lit(1), size=32))[0]).all() and (a != back(df, packed.augment(*AT, F.col("id"), F.lit(2), size=32))[0]).any()


def test_rings_against_fixed_pixels(spark):
    square = np.array([[1, 1], [5, 1], [5, 4], [1, 4], [1, 1]], float)
    hole = np.array([[2, 2], [4, 2], [4, 3], [2, 3]], float)
    assert ["".join(".#"[int(v)] for v in r) for r in packed.ring_mask([square, hole], 5, 6)] == ["......", ".####.", ".#..#.", ".####.", "......"]
    triangle = np.array([[0, 0], [6, 0], [0, 6]], float)
    assert packed.ring_mask([triangle], 6, 6).sum() in (15, 18, 21) and not packed.ring_mask([], 2, 2).any()
    assert packed.ring_mask([square + 100], 5, 6).sum() == 0
    lines = packed.ring_lines([square], 6, 7, width=1)
    assert ["".join(".#"[int(v)] for v in r) for r in lines] == [".......", ".#####.", ".#...#.", ".#...#.", ".#####.", "......."]
    df = frame(spark, image(6, 7), None).withColumn("rings", F.from_json(F.lit(json.dumps([square.tolist()])), "array<array<array<double>>>"))
    got = back(df, packed.overlay(*AT, F.col("rings"), width=1))
    want = image(6, 7).copy()
    want[lines] = packed.YELLOW
    assert (got[0].reshape(6, 7, 3) == want).all() and got[1] is None


def test_png_files_are_read_by_spark(spark, tmp_path):
    x, y = image(), image(n=1, seed=4)
    df = frame(spark, x, y, None)
    assert files.write_files(df, str(tmp_path / "out"), F.format_string("set/%d.png", "id"), packed.png(*AT)) == (2, 1)
    got = {r.origin.rsplit("/", 1)[1]: np.frombuffer(r.data, np.uint8).reshape(9, 12, -1) for r in spark.read.format("image").option("recursiveFileLookup", True).option("pathGlobFilter", "*.png").load(str(tmp_path / "out")).select("image.*").collect()}
    assert (got["0.png"][:, :, ::-1] == x).all() and (got["1.png"][:, :, :1] == y).all()
    assert json.loads((tmp_path / "out" / "_SUCCESS").read_text()) == {"saved": 2, "skipped": 1}


def test_files_are_committed_whole_or_not_at_all(spark, tmp_path):
    out = tmp_path / "out"
    df = spark.createDataFrame([(f"a/{i}.txt", f"text {i}".encode()) for i in range(20)] + [(None, b"x"), ("n.txt", None)], "name string, content binary").repartition(4)
    assert files.write_files(df, str(out), F.col("name"), F.col("content")) == (20, 2)
    assert sorted(p.name for p in out.iterdir()) == ["_SUCCESS", "a"] and (out / "a" / "7.txt").read_text() == "text 7"
    for bad in ([("b.txt", b"1"), ("../c.txt", b"2")], [("d.txt", b"1"), ("d.txt", b"2")]):
        with pytest.raises(Exception):
            files.write_files(spark.createDataFrame(bad, "name string, content binary"), str(out), F.col("name"), F.col("content"))
        assert sorted(p.name for p in out.iterdir()) == ["_SUCCESS", "a"] and not (tmp_path / "c.txt").exists()
    listing = spark.createDataFrame([(f"file:{out}/a/3.txt", "three.txt"), (f"{out}/none", "none.txt"), (None, "x")], "path string, name string")
    assert files.copy_files(listing, str(tmp_path / "copy")) == (1, 2) and (tmp_path / "copy" / "three.txt").read_text() == "text 3"
    assert files.write_files(spark.createDataFrame([("z.txt", b"")], "name string, content binary"), str(out), F.col("name"), F.col("content"), overwrite=True) == (1, 0)
    assert sorted(p.name for p in out.iterdir()) == ["_SUCCESS", "z.txt"]
