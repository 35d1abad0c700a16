"""GeoTIFF and BigTIFF rasters, read by tiles and strips and written with georeference.

Spark lists the files. A task reads a file's header by ranges (never the whole file) and gives one row a block, that is a
tile or a strip; windows are joined with the blocks they touch, and only those byte ranges are read and decoded, then cut
in the block and put together by window. A raster of any size is thus never held whole, and no row is larger than a block
or a window.

Pixels are packed: `data` is binary, row by row, pixel-interleaved (all bands of a pixel, then the next), in little-endian
samples of `dtype` (numpy's names: uint8, int16, float32, ...). Compression: none, LZW, deflate, PackBits; predictors:
none, horizontal differences (integers); chunky and planar files; both byte orders. Files or blocks that can't be decoded
give rows with an error text and null data, so that one bad file doesn't end a job. Blocks of no bytes are zeros.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the public TIFF and GeoTIFF standards.
TAGS = {
    256: "width", 257: "height", 258: "bits", 259: "compression", 262: "photometric", 273: "strip_offsets", 277: "bands", 278: "rows_per_strip",
    279: "strip_lengths", 284: "planar", 317: "predictor", 322: "tile_w", 323: "tile_h", 324: "tile_offsets", 325: "tile_lengths", 339: "format",
    33550: "scale", 33922: "tie", 34735: "keys",
}
FIELDS = {1: "B", 2: "B", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: GeoTIFF keys that hold an EPSG code: projected, geographic.
EPSG_KEYS = (3072, 2048)
KINDS = {1: "uint", 2: "int", 3: "float"}
#: Bytes of a header that are read at first; index rows that leave a task at a time.
HEAD, ROWS = 1 << 14, 4096

Reader = Callable[[int, int], bytes]


def opened(path: str) -> tuple[Reader, Callable[[], None]]:
    """(a function of offset and size, a function that closes) of a file in any file system that Arrow knows."""
    local = re.sub(r"^file:/*", "/", path)
    fs, name = (pafs.LocalFileSystem(), local) if "://" not in path or path.startswith("file:") else pafs.FileSystem.from_uri(path)
    f = fs.open_input_file(name)
    return (lambda at, n: f.read_at(n, at)), f.close


def header(read: Reader) -> dict:
    """Shape, layout, georeference and block ranges of a TIFF's first image."""
    head = read(0, HEAD)

    def get(at: int, n: int) -> bytes:
        data = head[at : at + n] if at + n <= len(head) else read(at, n)
        if len(data) < n:
            raise ValueError("the file is cut off")
        return data

    end = {b"II": "<", b"MM": ">"}.get(head[:2])
    magic = struct.unpack(end + "H", head[2:4])[0] if end and len(head) >= 8 else 0
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    big = magic == 43
    word, count_code, entry = ("Q", "Q", 20) if big else ("I", "H", 12)
    at = struct.unpack(end + word, get(8, 8) if big else get(4, 4))[0]
    size = struct.calcsize(count_code)
    n = struct.unpack(end + count_code, get(at, size))[0]
    table = get(at + size, n * entry)
    got: dict[str, tuple] = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(end + "HH" + word, table, i * entry)
        if tag not in TAGS or kind not in FIELDS:
            continue
        code, inline = FIELDS[kind], struct.calcsize(word)
        wide = struct.calcsize("<" + code) * count
        place = i * entry + 4 + inline
        data = table[place : place + wide] if wide <= inline else get(struct.unpack_from(end + word, table, place)[0], wide)
        got[TAGS[tag]] = struct.unpack(end + code * count, data)
    one = lambda k, default=None: int(got[k][0]) if k in got else default
    w, h, bands = one("width"), one("height"), one("bands", 1)
    if not w or not h or "bits" not in got and bands != 1:
        raise ValueError("width, height or bits are missing")
    bits, kind = one("bits", 1), KINDS.get(one("format", 1))
    if len(set(got.get("bits", (1,)))) > 1 or bits % 8 or kind is None:
        raise ValueError(f"samples of {got.get('bits')} bits are not supported")
    tiled = "tile_offsets" in got
    bw, bh = (one("tile_w"), one("tile_h")) if tiled else (w, min(one("rows_per_strip", h), h))
    offsets, lengths = (got[f"{'tile' if tiled else 'strip'}_{x}"] for x in ("offsets", "lengths"))
    across, down, planes = -(-w // bw), -(-h // bh), bands if one("planar", 1) == 2 and bands > 1 else 1
    if min(len(offsets), len(lengths)) < across * down * planes:
        raise ValueError("block offsets are missing")
    out = {"width": w, "height": h, "bands": bands, "dtype": np.dtype(f"{kind}{bits}").name, "block_w": bw, "block_h": bh, "tiled": tiled, "planes": planes}
    out |= {"end": end, "compression": one("compression", 1), "predictor": one("predictor", 1), "across": across, "down": down, "offsets": offsets, "lengths": lengths}
    out |= {"affine": None, "srid": None}
    if "scale" in got and "tie" in got:
        (sx, sy, *_), (i, j, _, x, y, _) = got["scale"], got["tie"][:6]
        out["affine"] = {"a": sx, "c": x - i * sx, "e": -sy, "f": y + j * sy}
    keys = got.get("keys", ())
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    out["srid"] = next((int(codes[k]) for k in EPSG_KEYS if codes.get(k, 32767) < 32767), None)
    return out


def unpacked(data: bytes) -> bytes:
    """PackBits."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 1 + (n > 128)
    return bytes(out)


def from_lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, high bits first, wider one code early; 256 clears, 257 ends."""
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, last = first.copy(), 9, b""
    out, held, n = [], 0, 0
    for byte in data:
        held, n = held << 8 | byte, n + 8
        if n < width:
            continue
        n -= width
        code, held = held >> n, held & ((1 << n) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = first.copy(), 9, b""
            continue
        if code > len(table) or (code == len(table) and not last):
            raise ValueError("broken LZW data")
        word = table[code] if code < len(table) else last + last[:1]
        out.append(word)
        if last:
            table.append(last + word[:1])
        last = word
        width = min(12, (len(table) + 1).bit_length())
    return b"".join(out)


def to_lzw(data: bytes) -> bytes:
    out, held, n = bytearray(), 0, 0
    table: dict[bytes, int] = {}
    width = 9

    def put(code: int) -> None:
        nonlocal held, n
        held, n = held << width | code, n + width
        while n >= 8:
            n -= 8
            out.append(held >> n & 255)
        held &= (1 << n) - 1

    def clear() -> None:
        nonlocal width
        put(256)
        table.clear()
        table.update({bytes([i]): i for i in range(256)})
        width = 9

    clear()
    word, following = b"", 258
    for i in range(len(data)):
        more = word + data[i : i + 1]
        if more in table:
            word = more
            continue
        put(table[word])
        table[more] = following
        following += 1
        if following == 4094:
            clear()
            following = 258
        elif following >= 1 << width:
            width += 1
        word = data[i : i + 1]
    if word:
        put(table[word])
        following += 1
        if following >= 1 << width and width < 12:
            width += 1
    put(257)
    if n:
        out.append(held << (8 - n) & 255)
    return bytes(out)


def decoded(raw: bytes, h: int, w: int, bands: int, dtype: str, end: str, compression: int, predictor: int) -> np.ndarray:
    """(h, w, bands) samples of one block's bytes."""
    kind = np.dtype(dtype).newbyteorder(end)
    size = h * w * bands * kind.itemsize
    if not raw:
        return np.zeros((h, w, bands), dtype)
    if compression in (DEFLATE, OLD_DEFLATE):
        raw = zlib.decompress(raw)
    elif compression == LZW:
        raw = from_lzw(raw)
    elif compression == PACKBITS:
        raw = unpacked(raw)
    elif compression != NONE:
        raise ValueError(f"compression {compression} is not supported")
    if len(raw) < size:
        raise ValueError(f"a block of {len(raw)} bytes, of which {size} are needed")
    x = np.frombuffer(raw, kind, h * w * bands).reshape(h, w, bands).astype(dtype)
    if predictor == 2 and kind.kind in "iu":
        return np.cumsum(x, axis=1, dtype=dtype)
    if predictor not in (1, None):
        raise ValueError(f"predictor {predictor} is not supported for {dtype}")
    return x


_HEADER = [("path", pa.string()), ("width", pa.int64()), ("height", pa.int64()), ("bands", pa.int32()), ("dtype", pa.string()), ("block_w", pa.int64()), ("block_h", pa.int64())]
_HEADER += [("affine", pa.struct([(c, pa.float64()) for c in "acef"])), ("srid", pa.int32())]
_ERROR = ("error", pa.string())
_BLOCK = [("ty", pa.int64()), ("tx", pa.int64()), ("offsets", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("stored_h", pa.int64()), ("end", pa.string()), ("compression", pa.int32()), ("predictor", pa.int32())]
_HEADER_DDL = "path string, width long, height long, bands int, dtype string, block_w long, block_h long, affine struct<a: double, c: double, e: double, f: double>, srid int"
_BLOCK_DDL = "ty long, tx long, offsets array<long>, lengths array<long>, stored_h long, end string, compression int, predictor int"


def _files(spark: SparkSession, path: str | list[str], pattern: str) -> DataFrame:
    """path of each file; contents are not read."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return listed.select("path")


def _of_header(h: dict, path: str) -> dict:
    return {"path": path} | {k: h[k] for k, _ in _HEADER[1:]}


def _blocks_of(h: dict, path: str) -> Iterator[dict]:
    each = h["across"] * h["down"]
    for k in range(each):
        ty, tx = divmod(k, h["across"])
        stored = h["block_h"] if h["tiled"] else min(h["block_h"], h["height"] - ty * h["block_h"])
        places = range(k, each * h["planes"], each)
        yield _of_header(h, path) | {"ty": ty, "tx": tx, "stored_h": stored, "offsets": [h["offsets"][i] for i in places], "lengths": [h["lengths"][i] for i in places]} | {c: h[c] for c in ("end", "compression", "predictor")}


def _described(files: DataFrame, blocks: bool) -> DataFrame:
    schema = pa.schema([*_HEADER, *(_BLOCK if blocks else []), _ERROR])

    def rows(path: str) -> Iterator[dict]:
        try:
            read, close = opened(path)
            try:
                h = header(read)
            finally:
                close()
            yield from _blocks_of(h, path) if blocks else [_of_header(h, path)]
        except (ValueError, KeyError, IndexError, OSError, struct.error) as e:
            yield {"path": path, "error": repr(e)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                some: list[dict] = []
                for row in rows(path):
                    some.append(row)
                    if len(some) == ROWS:
                        yield pa.RecordBatch.from_pylist(some, schema)
                        some = []
                if some:
                    yield pa.RecordBatch.from_pylist(some, schema)

    return files.mapInArrow(run, f"{_HEADER_DDL}, {_BLOCK_DDL + ', ' if blocks else ''}error string")


def read_headers(spark: SparkSession, path: str | list[str], pattern: str = "*.{tif,tiff}") -> DataFrame:
    """path, width, height, bands, dtype, block_w, block_h, affine struct<a, c, e, f>, srid, error of each file, by its header's bytes."""
    return _described(_files(spark, path, pattern), False)


def read_index(spark: SparkSession, path: str | list[str], pattern: str = "*.{tif,tiff}") -> DataFrame:
    """The header's columns and ty, tx, offsets, lengths, ... of each block: where its bytes are."""
    return _described(_files(spark, path, pattern), True)


def read_blocks(index: DataFrame) -> DataFrame:
    """path, ty, tx, row0, col0, h, w, bands, dtype, data, error of the index's blocks, cut at the raster's edges.

    Filter the index first: the bytes of other blocks are not read. A task opens a file once for neighbouring rows.
    """
    names = [("path", pa.string()), ("ty", pa.int64()), ("tx", pa.int64()), ("row0", pa.int64()), ("col0", pa.int64()), ("h", pa.int64()), ("w", pa.int64()), ("bands", pa.int32()), ("dtype", pa.string()), ("data", pa.binary()), _ERROR]
    schema = pa.schema(names)

    def one(r: dict, read: Reader) -> dict:
        row0, col0 = r["ty"] * r["block_h"], r["tx"] * r["block_w"]
        h, w = min(r["block_h"], r["height"] - row0), min(r["block_w"], r["width"] - col0)
        out = {k: r[k] for k in ("path", "ty", "tx", "bands", "dtype")} | {"row0": row0, "col0": col0, "h": h, "w": w}
        planes = len(r["offsets"])
        try:
            parts = [decoded(read(at, n) if n else b"", r["stored_h"], r["block_w"], r["bands"] if planes == 1 else 1, r["dtype"], r["end"], r["compression"], r["predictor"]) for at, n in zip(r["offsets"], r["lengths"])]
            x = parts[0] if planes == 1 else np.concatenate(parts, axis=2)
            return out | {"data": np.ascontiguousarray(x[:h, :w]).astype(x.dtype.newbyteorder("<")).tobytes()}
        except (ValueError, OSError, zlib.error, IndexError) as e:
            return out | {"error": repr(e)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, read, close = None, None, lambda: None
        try:
            for batch in batches:
                for r in batch.to_pylist():
                    if r["error"] is not None:
                        yield pa.RecordBatch.from_pylist([{"path": r["path"], "error": r["error"]}], schema)
                        continue
                    if r["path"] != path:
                        close()
                        path, (read, close) = r["path"], opened(r["path"])
                    yield pa.RecordBatch.from_pylist([one(r, read)], schema)
        finally:
            close()

    return index.mapInArrow(run, "path string, ty long, tx long, row0 long, col0 long, h long, w long, bands int, dtype string, data binary, error string")


def cut(data: Column, h: Column, w: Column, pixel: Column, r0: Column, c0: Column, r1: Column, c1: Column) -> Column:
    """Rows r0 to r1 and columns c0 to c1 of packed pixels of `pixel` bytes."""

    @F.pandas_udf("binary")
    def run(data: pd.Series, h: pd.Series, w: pd.Series, pixel: pd.Series, r0: pd.Series, c0: pd.Series, r1: pd.Series, c1: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else np.frombuffer(x, np.uint8).reshape(a, b * p)[i:k, j * p : m * p].tobytes() for x, a, b, p, i, j, k, m in zip(data, h, w, pixel, r0, c0, r1, c1)], dtype=object)

    return run(data, h, w, pixel, r0, c0, r1, c1)


def assembled(pieces: Column, h: Column, w: Column, pixel: Column) -> Column:
    """Packed pixels of h x w put together from pieces array<struct<r, c, h, w, data>>; what no piece covers is 0."""

    @F.pandas_udf("binary")
    def run(pieces: pd.Series, h: pd.Series, w: pd.Series, pixel: pd.Series) -> pd.Series:
        out = []
        for some, a, b, p in zip(pieces, h, w, pixel):
            image = np.zeros((a, b * p), np.uint8)
            for x in some:
                if x["data"] is not None:
                    image[x["r"] : x["r"] + x["h"], x["c"] * p : (x["c"] + x["w"]) * p] = np.frombuffer(x["data"], np.uint8).reshape(x["h"], x["w"] * p)
            out.append(image.tobytes())
        return pd.Series(out, dtype=object)

    return run(pieces, h, w, pixel)


def touched(windows: DataFrame, block_h: str = "block_h", block_w: str = "block_w") -> DataFrame:
    """A row for each block (ty, tx) that a window (row0, col0, row1, col1; ends exclusive) touches; empty windows have none."""
    span = lambda low, high, size: F.when(F.col(low) < F.col(high), F.sequence(F.floor(F.col(low) / F.col(size)), F.floor((F.col(high) - 1) / F.col(size)))).otherwise(F.array().cast("array<bigint>"))
    return windows.withColumn("ty", F.explode(span("row0", "row1", block_h))).withColumn("tx", F.explode(span("col0", "col1", block_w)))


def windows_of_blocks(windows: DataFrame, blocks: DataFrame, key: str, raster: str = "path") -> DataFrame:
    """`key`, h, w, bands, dtype, data, error of windows (key, raster, row0, col0, row1, col1, ty, tx as `touched` gives them).

    `blocks` has raster, ty, tx, row0, col0, h, w, bands, dtype, data, error. A window is cut in each of its blocks, and
    its pieces, which are no more than the window itself, are put together.
    """
    b = blocks.select(raster, "ty", "tx", F.struct("row0", "col0", "h", "w", "data").alias("b"), "bands", "dtype", "error")
    met = windows.join(b, [raster, "ty", "tx"])
    r0, r1 = F.greatest("row0", "b.row0"), F.least("row1", F.col("b.row0") + F.col("b.h"))
    c0, c1 = F.greatest("col0", "b.col0"), F.least("col1", F.col("b.col0") + F.col("b.w"))
    pixel = F.col("bands") * F.when(F.col("dtype").endswith("64"), 8).when(F.col("dtype").endswith("32"), 4).when(F.col("dtype").endswith("16"), 2).otherwise(1)
    met = met.withColumns({"r0": r0, "r1": r1, "c0": c0, "c1": c1, "pixel": pixel.cast("int")})
    part = cut(F.col("b.data"), F.col("b.h"), F.col("b.w"), F.col("pixel"), F.col("r0") - F.col("b.row0"), F.col("c0") - F.col("b.col0"), F.col("r1") - F.col("b.row0"), F.col("c1") - F.col("b.col0"))
    piece = F.struct((F.col("r0") - F.col("row0")).alias("r"), (F.col("c0") - F.col("col0")).alias("c"), (F.col("r1") - F.col("r0")).alias("h"), (F.col("c1") - F.col("c0")).alias("w"), F.col("part").alias("data"))
    met = met.withColumn("part", part).withColumn("piece", piece)
    whole = met.groupBy(key, (F.col("row1") - F.col("row0")).alias("h"), (F.col("col1") - F.col("col0")).alias("w")).agg(
        F.collect_list("piece").alias("pieces"), F.first("bands").alias("bands"), F.first("dtype").alias("dtype"), F.first("pixel").alias("pixel"), F.first("error", ignorenulls=True).alias("error")
    )
    return whole.select(key, "h", "w", "bands", "dtype", assembled(F.col("pieces"), F.col("h"), F.col("w"), F.col("pixel")).alias("data"), "error")


def clipped(windows: DataFrame) -> DataFrame:
    """Windows kept inside their raster (width, height)."""
    inside = lambda c, size: F.least(F.greatest(F.col(c), F.lit(0)), F.col(size)).cast("bigint")
    return windows.withColumns({"row0": inside("row0", "height"), "row1": inside("row1", "height"), "col0": inside("col0", "width"), "col1": inside("col1", "width")})


def read_windows(spark: SparkSession, windows: DataFrame, path: str | list[str], key: str = "id", raster: str = "path") -> DataFrame:
    """key, row0, col0, h, w, bands, dtype, affine, srid, data, error of windows (key, path, row0, col0, row1, col1; ends exclusive).

    Windows are clipped to their raster; what is left of one outside has no row. Each touched block is read and decoded
    once, however many windows touch it.
    """
    heads = read_headers(spark, path).where("error IS NULL").select(F.col("path").alias(raster), "width", "height", "block_w", "block_h", "affine", "srid")
    at = clipped(windows.select(key, raster, "row0", "col0", "row1", "col1").join(heads, raster))
    parts = touched(at).select(key, raster, "row0", "col0", "row1", "col1", "ty", "tx")
    index = read_index(spark, path).where("error IS NULL").withColumnRenamed("path", raster)
    wanted = index.join(parts.select(raster, "ty", "tx").distinct(), [raster, "ty", "tx"], "left_semi").withColumnRenamed(raster, "path").withColumn("error", F.lit(None).cast("string"))
    found = windows_of_blocks(parts, read_blocks(wanted.select(*[c for c, _ in _HEADER], *[c for c, _ in _BLOCK], "error")).withColumnRenamed("path", raster), key, raster)
    shifted = F.struct(F.col("affine.a").alias("a"), (F.col("affine.c") + F.col("col0") * F.col("affine.a")).alias("c"), F.col("affine.e").alias("e"), (F.col("affine.f") + F.col("row0") * F.col("affine.e")).alias("f"))
    meta = at.select(key, "row0", "col0", F.when(F.col("affine").isNotNull(), shifted).alias("affine"), "srid")
    return meta.join(found, key).select(key, "row0", "col0", "h", "w", "bands", "dtype", "affine", "srid", "data", "error")


def encoded(data: bytes, h: int, w: int, bands: int, dtype: str = "uint8", affine: dict | None = None, srid: int | None = None, compression: int = LZW, predictor: int = 1, tile: int | None = None, planar: bool = False, end: str = "<", big: bool = False) -> bytes:
    """A TIFF file of packed pixels, in strips of about 64 KB or square tiles, with georeference where it is given."""
    kind = np.dtype(dtype)
    x = np.frombuffer(data, kind.newbyteorder("<"), h * w * bands).reshape(h, w, bands).astype(kind)
    bw, bh = (tile, tile) if tile else (w, max(1, min(h, 65536 // max(1, w * bands * kind.itemsize))))
    blocks = []
    for plane in np.split(x, bands, axis=2) if planar else [x]:
        for r in range(0, h, bh):
            for c in range(0, w, bw):
                b = plane[r : r + bh, c : c + bw]
                if tile:
                    b = np.pad(b, ((0, bh - b.shape[0]), (0, bw - b.shape[1]), (0, 0)))
                if predictor == 2:
                    b = np.diff(b, axis=1, prepend=np.zeros_like(b[:, :1]))
                raw = b.astype(kind.newbyteorder(end)).tobytes()
                if compression not in (NONE, LZW, DEFLATE):
                    raise ValueError("files are written without compression, with LZW or with deflate")
                blocks.append(raw if compression == NONE else to_lzw(raw) if compression == LZW else zlib.compress(raw))
    word, code = ("Q", 16) if big else ("I", 4)
    fields: list[tuple[int, int, tuple]] = [(256, 4, (w,)), (257, 4, (h,)), (258, 3, (kind.itemsize * 8,) * bands), (259, 3, (compression,)), (262, 3, (2 if bands >= 3 else 1,)), (277, 3, (bands,))]
    fields += [(284, 3, (2 if planar else 1,)), (317, 3, (predictor,)), (339, 3, ({"u": 1, "i": 2, "f": 3}[kind.kind],) * bands)]
    fields += [(338, 3, (2 if bands == 4 else 0,) * (bands - 3))] if bands > 3 else [(338, 3, (0,))] if bands == 2 else []
    fields += [(322, 4, (bw,)), (323, 4, (bh,)), (324, code, tuple(range(len(blocks)))), (325, code, tuple(map(len, blocks)))] if tile else [(278, 4, (bh,)), (273, code, tuple(range(len(blocks)))), (279, code, tuple(map(len, blocks)))]
    if affine is not None:
        fields += [(33550, 12, (affine["a"], -affine["e"], 0.0)), (33922, 12, (0.0, 0.0, 0.0, affine["c"], affine["f"], 0.0))]
    if srid is not None:
        degrees = srid == 4326
        fields.append((34735, 3, (1, 1, 0, 3, 1024, 0, 1, 2 if degrees else 1, 1025, 0, 1, 1, 2048 if degrees else 3072, 0, 1, srid)))
    fields.sort()
    start = 16 if big else 8
    head = (b"II" if end == "<" else b"MM") + (struct.pack(end + "HHHQ", 43, 8, 0, start) if big else struct.pack(end + "HI", 42, start))
    entry, inline = (20, 8) if big else (12, 4)
    places = {}
    at = start + struct.calcsize("<Q" if big else "<H") + len(fields) * entry + inline
    for tag, k, v in fields:
        size = struct.calcsize("<" + FIELDS[k]) * len(v)
        if size > inline:
            places[tag] = at
            at += size + size % 2
    ends = np.cumsum([0, *map(len, blocks)]) + at
    table, rest = struct.pack(end + ("Q" if big else "H"), len(fields)), b""
    for tag, k, v in fields:
        v = tuple(map(int, ends[:-1])) if tag in (273, 324) else v
        body = struct.pack(end + FIELDS[k] * len(v), *v)
        table += struct.pack(end + "HH" + word, tag, k, len(v)) + (struct.pack(end + word, places[tag]) if tag in places else body.ljust(inline, b"\0"))
        rest += body + b"\0" * (len(body) % 2) if tag in places else b""
    return head + table + bytes(inline) + rest + b"".join(blocks)


def tiff(data: Column, h: Column, w: Column, bands: Column, dtype: Column, affine: Column | None = None, srid: Column | None = None, compression: int = LZW) -> Column:
    """GeoTIFF files of packed pixels, as a binary column; null pixels give null."""

    @F.pandas_udf("binary")
    def run(data: pd.Series, h: pd.Series, w: pd.Series, bands: pd.Series, dtype: pd.Series, a: pd.Series, c: pd.Series, e: pd.Series, f: pd.Series, srid: pd.Series) -> pd.Series:
        out = []
        for x, i, j, n, kind, *t, code in zip(data, h, w, bands, dtype, a, c, e, f, srid):
            place = None if any(pd.isna(v) for v in t) else dict(zip("acef", t))
            out.append(None if x is None else encoded(x, int(i), int(j), int(n), kind, place, None if pd.isna(code) else int(code), compression))
        return pd.Series(out, dtype=object)

    none = F.lit(None).cast("double")
    t = [none] * 4 if affine is None else [affine[c] for c in "acef"]
    return run(data, h, w, bands, dtype, *t, F.lit(None).cast("int") if srid is None else srid)
