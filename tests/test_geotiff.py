"""GeoTIFF files written and read back by blocks and windows."""

import numpy as np
import pytest

from terragrid.sources import geotiff

AFFINE = {"a": 0.5, "c": 100.0, "e": -0.5, "f": 900.0}


def image(h, w, bands, dtype, seed=0):
    g = np.random.default_rng(seed)
    x = np.cumsum(g.integers(-3, 4, (h, w, bands)), axis=1)
    return (x % 251).astype(dtype) if np.dtype(dtype).kind == "u" else x.astype(dtype)


def packed(x):
    return np.ascontiguousarray(x).astype(x.dtype.newbyteorder("<")).tobytes()


def whole(data):
    """All blocks of a file's bytes, put together."""
    read = lambda at, n: data[at : at + n]
    h = geotiff.header(read)
    out = np.zeros((h["height"], h["width"], h["bands"]), h["dtype"])
    for b in geotiff._blocks_of(h, "x"):
        one = [geotiff.decoded(read(o, n), b["stored_h"], b["block_w"], 1 if h["planes"] > 1 else h["bands"], b["dtype"], b["end"], b["compression"], b["predictor"]) for o, n in zip(b["offsets"], b["lengths"])]
        x, r, c = np.concatenate(one, axis=2), b["ty"] * b["block_h"], b["tx"] * b["block_w"]
        part = out[r : r + b["block_h"], c : c + b["block_w"]]
        part[:] = x[: part.shape[0], : part.shape[1]]
    return h, out


@pytest.mark.parametrize("compression", [geotiff.NONE, geotiff.LZW, geotiff.DEFLATE])
@pytest.mark.parametrize(("dtype", "predictor"), [("uint8", 1), ("uint8", 2), ("uint16", 2), ("int16", 1), ("float32", 1)])
@pytest.mark.parametrize("layout", [{}, {"tile": 16}, {"tile": 32, "planar": True, "end": ">"}, {"big": True, "end": ">"}, {"big": True, "tile": 16}])
def test_round_trip(compression, dtype, predictor, layout):
    for h, w, bands in ((1, 1, 1), (50, 70, 3), (33, 16, 4)):
        x = image(h, w, bands, dtype)
        head, got = whole(geotiff.encoded(packed(x), h, w, bands, dtype, AFFINE, 32719, compression, predictor, **layout))
        assert got.dtype == x.dtype and (got == x).all()
        assert head["affine"] == AFFINE and head["srid"] == 32719 and (head["width"], head["height"], head["bands"]) == (w, h, bands)


def test_lzw_and_packbits():
    g = np.random.default_rng(1)
    for data in (b"", b"a", bytes(5000), g.integers(0, 256, 40_000).astype(np.uint8).tobytes(), g.integers(0, 3, 60_000).astype(np.uint8).tobytes(), b"abc" * 9000):
        assert geotiff.from_lzw(geotiff.to_lzw(data)) == data
    # the example of the public PackBits note
    assert geotiff.unpacked(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")).hex() == "aaaaaa80002aaaaaaaaa80002a22" + "aa" * 10


def test_pillow_free_reader_agrees_with_spark(spark, tmp_path):
    """Files that Spark's image source (the JVM's decoder) also reads give the same pixels."""
    x = image(40, 30, 3, "uint8", 3)
    (tmp_path / "a.tif").write_bytes(geotiff.encoded(packed(x), 40, 30, 3, compression=geotiff.LZW))
    (tmp_path / "b.tif").write_bytes(geotiff.encoded(packed(x), 40, 30, 3, compression=geotiff.DEFLATE, tile=16))
    for r in spark.read.format("image").load(str(tmp_path)).select("image.*").collect():
        assert (np.frombuffer(r.data, np.uint8).reshape(40, 30, 3)[:, :, ::-1] == x).all()


@pytest.fixture
def rasters(tmp_path):
    x, y = image(100, 130, 3, "uint8", 1), image(64, 40, 1, "uint16", 2)
    (tmp_path / "one.tif").write_bytes(geotiff.encoded(packed(x), 100, 130, 3, affine=AFFINE, srid=32719, tile=32, predictor=2))
    (tmp_path / "two.tiff").write_bytes(geotiff.encoded(packed(y), 64, 40, 1, "uint16", compression=geotiff.DEFLATE))
    (tmp_path / "bad.tif").write_bytes(b"II*\0nothing here")
    (tmp_path / "cut.tif").write_bytes(geotiff.encoded(packed(x), 100, 130, 3)[:200])
    return tmp_path, x, y


def test_headers_and_blocks(spark, rasters):
    path, x, y = rasters
    heads = {r.path.rsplit("/", 1)[1]: r for r in geotiff.read_headers(spark, str(path)).collect()}
    assert heads["one.tif"].affine.asDict() == AFFINE and heads["one.tif"].srid == 32719 and heads["one.tif"].error is None
    assert (heads["two.tiff"].dtype, heads["two.tiff"].affine, heads["two.tiff"].srid) == ("uint16", None, None)
    assert heads["bad.tif"].error and heads["cut.tif"].error is None  # its header is whole, its strip is not
    rows = geotiff.read_blocks(geotiff.read_index(spark, str(path))).collect()
    assert sum(r.error is not None for r in rows) == 2
    got = {"one.tif": np.zeros_like(x), "two.tiff": np.zeros_like(y)}
    for r in rows:
        if r.error is None:
            got[r.path.rsplit("/", 1)[1]][r.row0 : r.row0 + r.h, r.col0 : r.col0 + r.w] = np.frombuffer(r.data, r["dtype"]).reshape(r.h, r.w, r.bands)
    assert (got["one.tif"] == x).all() and (got["two.tiff"] == y).all()


def test_windows_over_block_borders(spark, rasters):
    path, x, y = rasters
    one, two = f"file:{path}/one.tif", f"file:{path}/two.tiff"
    at = [(1, one, 5, 7, 12, 20), (2, one, 20, 20, 75, 99), (3, one, -10, 100, 40, 500), (4, two, 0, 0, 64, 40), (5, one, 200, 0, 300, 10), (6, one, 0, 0, 1, 1), (7, "nowhere", 0, 0, 1, 1), (8, one, 20, 20, 75, 99), (9, one, 9, 9, 9, 20)]
    windows = spark.createDataFrame(at, "id long, path string, row0 long, col0 long, row1 long, col1 long")
    got = {r.id: r for r in geotiff.read_windows(spark, windows, str(path)).collect()}
    assert sorted(got) == [1, 2, 3, 4, 6, 8]
    for i, p, r0, c0, r1, c1 in at:
        if i in got:
            want = (y if p == two else x)[max(r0, 0) : r1, max(c0, 0) : c1]
            r = got[i]
            assert (r.h, r.w, r.bands) == want.shape and (np.frombuffer(r.data, r["dtype"]).reshape(want.shape) == want).all() and r.error is None
    assert got[2].affine.asDict() == {"a": 0.5, "c": 110.0, "e": -0.5, "f": 890.0} and got[4].affine is None


def test_only_touched_ranges_are_read(spark, tmp_path):
    """A window is right although every other block of the file is overwritten."""
    x = image(100, 130, 3, "uint8", 1)
    data = bytearray(geotiff.encoded(packed(x), 100, 130, 3, tile=32, compression=geotiff.DEFLATE))
    h = geotiff.header(lambda at, n: bytes(data[at : at + n]))
    for k, (at, n) in enumerate(zip(h["offsets"], h["lengths"])):
        if k != 6:  # ty 1, tx 1
            data[at : at + n] = b"\xff" * n
    (tmp_path / "a.tif").write_bytes(data)
    windows = spark.createDataFrame([(1, f"file:{tmp_path}/a.tif", 33, 40, 60, 64), (2, f"file:{tmp_path}/a.tif", 0, 0, 4, 4)], "id long, path string, row0 long, col0 long, row1 long, col1 long")
    got = {r.id: r for r in geotiff.read_windows(spark, windows, str(tmp_path)).collect()}
    assert (np.frombuffer(got[1].data, np.uint8).reshape(27, 24, 3) == x[33:60, 40:64]).all() and got[1].error is None
    assert got[2].error is not None


def test_tiff_column_is_read_back(spark, tmp_path):
    from pyspark.sql import functions as F

    x = image(20, 31, 3, "uint8", 5)
    df = spark.createDataFrame([(bytearray(packed(x)), 20, 31, 3, "uint8", (0.5, 100.0, -0.5, 900.0), 4326), (None, 1, 1, 1, "uint8", None, None)], "data binary, h long, w long, bands int, dtype string, t struct<a: double, c: double, e: double, f: double>, srid int")
    files = [r[0] for r in df.select(geotiff.tiff(F.col("data"), F.col("h"), F.col("w"), F.col("bands"), F.col("dtype"), F.col("t"), F.col("srid"))).collect()]
    head, got = whole(bytes(files[0]))
    assert files[1] is None and (got == x).all() and head["affine"] == AFFINE and head["srid"] == 4326
