"""Extraction of polygons from georeferenced mosaics: pixels, metadata records and files of each, and resizing with georeference.

The polygons' windows are read from the tiles and strips they touch (`sources.geotiff`), over as many files as a polygon
names; no raster is held whole. A record is one row with its pixels; files are written by one job.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from terragrid.functions import geometry, labels, packed
from terragrid.operators import grids, lookups
from terragrid.sources import files, geotiff

# The stem of a polygon's files, and the endings of their names.
STEM = "geoglif"
ENDINGS = {"ortho_tif": "_ortho.tif", "ortho_jpeg": "_ortho.png", "overlay_jpeg": "_overlay.png"}


def base_name(index: Column) -> Column:
    return labels.numbered(F.lit(STEM), index)


def record(df: DataFrame) -> Column:
    """The metadata record of rows with polygon_index, class, bounds, srid, polygon_points, h, w, bands."""
    named = F.struct(*[F.concat(base_name(F.col("polygon_index")), F.lit(e)).alias(k) for k, e in ENDINGS.items()])
    shape = F.struct(F.col("h").cast("int").alias("height"), F.col("w").cast("int").alias("width"), F.col("bands").cast("int").alias("channels"))
    size = geometry.box_metres_in(F.col("bounds"), F.col("srid")).alias("bbox_size_meters")
    crs = F.when(F.col("srid").isNotNull(), F.concat(F.lit("EPSG:"), F.col("srid"))).alias("crs")
    return F.struct("polygon_index", "class", "bounds", size, crs, "polygon_points", shape.alias("image_shape"), named.alias("files"))


def placed(polygons: DataFrame, rasters: DataFrame, pad: float = 0.05) -> DataFrame:
    """Polygons (fid, class, polygon_points, srid, raster) in their raster's CRS, with bounds over all parts and windows.

    `rasters` has path, affine, srid. Holes and further parts are kept; coordinates beyond x and y are dropped.
    """
    r = rasters.select(F.col("path").alias("raster"), "affine", F.col("srid").alias("raster_srid"))
    out = polygons.select(F.col("fid").alias("polygon_index"), "class", "polygon_points", "srid", "raster").join(r, "raster")
    out = out.withColumn("polygon_points", geometry.reproject_parts(F.col("polygon_points"), F.col("srid"), F.col("raster_srid")))
    out = out.withColumn("srid", F.coalesce("raster_srid", "srid")).drop("raster_srid")
    out = out.withColumn("bounds", geometry.ring_bounds(F.flatten(F.transform("polygon_points", lambda p: p["exterior"]))))
    out = out.withColumn("window", geometry.pixel_window(F.col("bounds"), F.col("affine")))
    return out.withColumn("padded", geometry.pixel_window(geometry.padded(F.col("bounds"), pad), F.col("affine")))


def extracted(spark: SparkSession, polygons: DataFrame, path: str | list[str], class_code: int | None = None, limit: int | None = None, pad: float = 0.05) -> DataFrame:
    """One row a polygon: record, and struct<row0, col0, h, w, bands, dtype, affine, srid, data, error> of `image` and `padded`.

    The limit comes before the class filter. Polygons without geometry, without a readable raster, or outside theirs have
    no row. Windows are clipped to the raster.
    """
    at = placed(lookups.class_filter(polygons, class_code, limit), geotiff.read_headers(spark, path).where("error IS NULL"), pad)
    window = lambda kind, c: F.struct(F.struct("polygon_index", "raster", F.lit(kind).alias("kind")).alias("id"), F.col("raster").alias("path"), *[F.col(f"{c}.{x}").alias(x) for x in ("row0", "col0", "row1", "col1")])
    wanted = at.select(F.explode(F.array(window("image", "window"), window("padded", "padded"))).alias("x")).select("x.*")
    found = geotiff.read_windows(spark, wanted, path)
    inner = F.struct(*[c for c in found.columns if c != "id"])
    both = found.groupBy("id.polygon_index", "id.raster").agg(*[F.first(F.when(F.col("id.kind") == k, inner), ignorenulls=True).alias(k) for k in ("image", "padded")])
    rows = at.drop("window", "padded", "affine").join(both.where("image IS NOT NULL"), ["polygon_index", "raster"])
    flat = rows.withColumns({c: F.col(f"image.{c}") for c in ("h", "w", "bands")})
    return flat.withColumn("record", record(flat)).select("raster", "record", "image", "padded")


def documents(rows: DataFrame) -> DataFrame:
    """name, content of each polygon's files, from `extracted`: GeoTIFF, PNG, overlay PNG and metadata (JSON)."""
    part = lambda c: [F.col(f"{c}.{x}") for x in ("h", "w", "bands")]
    base = base_name(F.col("record.polygon_index"))
    eight = lambda c: packed.to_uint8(F.col(f"{c}.data"), F.col(f"{c}.dtype"))
    t = F.col("padded.affine")
    ring = lambda r: F.transform(r, lambda p: F.array((p[0] - t["c"]) / t["a"], (p[1] - t["f"]) / t["e"]))
    out = rows.withColumn("rings", F.transform("record.polygon_points", lambda p: ring(p["exterior"])))
    out = out.withColumns({"small": eight("image"), "wide": eight("padded")})
    h, w, n = part("padded")
    out = out.withColumn("wide", packed.overlay(F.col("wide"), h, w, n, F.col("rings")))
    content = {
        "ortho_tif": geotiff.tiff(F.col("image.data"), *part("image"), F.col("image.dtype"), F.col("image.affine"), F.col("image.srid"), geotiff.NONE),
        "ortho_jpeg": packed.png(F.col("small"), *part("image")),
        "overlay_jpeg": packed.png(F.col("wide"), h, w, F.lit(3)),
    }
    all_ = [F.struct(F.col(f"record.files.{k}").alias("name"), c.alias("content")) for k, c in content.items()]
    meta = F.struct(F.concat(base, F.lit("_metadata.json")).alias("name"), F.to_json("record").cast("binary").alias("content"))
    return out.select(F.explode(F.array(*all_, meta)).alias("f")).select("f.*")


def write_extraction(rows: DataFrame, path: str) -> tuple[int, int]:
    """Writes the files of `documents`; (saved, skipped)."""
    return files.write_files(documents(rows), path, F.col("name"), F.col("content"))


def resized_georeferenced(images: DataFrame, scale: float, kind: str = "chebyshev") -> DataFrame:
    """Images (data, h, w, bands, dtype uint8, affine, ...) of three bands, or one, at `scale`; the affine covers the same area."""
    keep = F.when(F.col("bands") >= 3, 3).otherwise(1)
    first = F.when(F.col("bands") >= 3, packed.rgb(F.col("data"), F.col("h"), F.col("w"), F.col("bands"))).otherwise(packed.gray(F.col("data"), F.col("h"), F.col("w"), F.col("bands")))
    out = images.withColumns({"data": first, "bands": keep})
    h, w = (F.rint(F.col(c) * scale).cast("long") for c in ("h", "w"))
    out = out.withColumns({"new_h": h, "new_w": w})
    out = out.withColumn("data", packed.resized(F.col("data"), F.col("h"), F.col("w"), F.col("bands"), F.col("new_h"), F.col("new_w"), kind))
    out = out.withColumns({"h": F.col("new_h"), "w": F.col("new_w"), "affine": geometry.rescaled(F.col("affine"), F.lit(scale), F.lit(scale))})
    return out.drop("new_h", "new_w")


def write_resized(images: DataFrame, path: str, name: Column, scale: float, kind: str = "chebyshev") -> tuple[int, int]:
    """Writes images at `scale` as LZW GeoTIFFs with their shifted georeference; (saved, skipped)."""
    out = resized_georeferenced(images.withColumn("file_name", name), scale, kind)
    body = geotiff.tiff(F.col("data"), F.col("h"), F.col("w"), F.col("bands"), F.lit("uint8"), F.col("affine"), F.col("srid"), geotiff.LZW)
    return files.write_files(out, path, F.col("file_name"), body)


def patch_files(images: DataFrame, ring: str = "ring", size: int = grids.PATCH, step: int = grids.STEP, threshold: float = grids.OVERLAP) -> DataFrame:
    """name, content, accepted of the patches of images (base, data, h, w, bands, a ring column), and of the originals (accepted null).

    Patches that overlap the ring too little go to a folder `rejected` beside the others. An image's patches are judged
    without its pixels and cut from it in one batch, so that its pixels are not repeated.
    """
    cut = lookups.judged_patches(grids.sliding_patches(images.select("base", "h", "w", ring), size, step), ring, threshold)
    at = cut.groupBy("base").agg(F.collect_list(F.struct("i", "j", "x0", "y0", "accepted")).alias("cuts"))

    @F.pandas_udf("array<binary>")
    def pieces(data: pd.Series, h: pd.Series, w: pd.Series, bands: pd.Series, cuts: pd.Series) -> pd.Series:
        out = []
        for x, a, b, n, some in zip(data, h, w, bands, cuts):
            image = None if x is None else np.frombuffer(x, np.uint8).reshape(a, b, n)
            out.append(None if image is None or some is None else [image[c["y0"] : c["y0"] + size, c["x0"] : c["x0"] + size].tobytes() for c in some])
        return pd.Series(out, dtype=object)

    three = packed.rgb(F.col("data"), F.col("h"), F.col("w"), F.col("bands"))
    rows = images.select("base", "h", "w", three.alias("data")).join(at, "base", "left")
    rows = rows.withColumn("pieces", pieces(F.col("data"), F.col("h"), F.col("w"), F.lit(3), F.col("cuts")))
    each = rows.select("base", F.explode(F.arrays_zip("cuts", "pieces")).alias("x")).select("base", "x.cuts.*", F.col("x.pieces").alias("data"))
    folder = F.when(F.col("accepted"), F.lit("/")).otherwise(F.lit("/rejected/"))
    name = F.concat(F.col("base"), folder, F.format_string("patch_%03d_%03d.png", "i", "j"))
    side = F.lit(size)
    patches = each.select(name.alias("name"), packed.png(F.col("data"), side, side, F.lit(3)).alias("content"), "accepted")
    original = F.concat(F.col("base"), F.lit("/"), F.element_at(F.split("base", "/"), -1), F.lit("_original.png"))
    return patches.unionByName(rows.select(original.alias("name"), packed.png(F.col("data"), F.col("h"), F.col("w"), F.lit(3)).alias("content"), F.lit(None).cast("boolean").alias("accepted")))


def write_patches(images: DataFrame, path: str, **options) -> tuple[int, int]:
    """Writes `patch_files`; (accepted, rejected) as the same job has observed them."""
    seen = Observation()
    rows = patch_files(images, **options)
    rows = rows.observe(seen, F.count(F.when(F.col("accepted"), 1)).alias("saved"), F.count(F.when(~F.col("accepted"), 1)).alias("skipped"))
    files.write_files(rows, path, F.col("name"), F.col("content"))
    return seen.get["saved"], seen.get["skipped"]


def copy_class(records: DataFrame, source: str, path: str, class_code: int = 1) -> tuple[int, int]:
    """Copies the files and the metadata of a class's records (polygon_index, class, files map or struct as text values) into a folder by name."""
    own = records.where(F.col("class") == class_code)
    names = F.concat(F.map_values("files"), F.array(F.concat(base_name(F.col("polygon_index")), F.lit("_metadata.json"))))
    listing = own.select(F.explode(names).alias("name")).where("name IS NOT NULL").distinct()
    return files.copy_files(listing.select(F.concat(F.lit(source.rstrip("/") + "/"), "name").alias("path"), "name"), path)
