"""End-to-end plans: each is one lazy DataFrame over the operators, so Catalyst prunes columns and pushes filters through.

Images are rows (image_id, v, h, w, ...); pixels are cut only where a step needs them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terragrid.functions import geometry, labels, pixels, texture
from terragrid.operators import grids, lookups, stats


def extraction(polygons: DataFrame, rasters: DataFrame, srid: int | None = None, class_code: int | None = None, limit: int | None = None) -> DataFrame:
    """Polygons (fid, class, polygon_points, srid, raster) with the pixel windows and metadata of their raster.

    The limit comes before the class filter; rings of `srid` are moved to the CRS of each raster (its column srid; null: as they are). Columns: polygon_index, class,
    class_name, bounds, padded window, window (rows and columns), transform of the window.
    """
    out = lookups.class_filter(polygons, class_code, limit)
    ring = F.get("polygon_points", F.lit(0))["exterior"]
    out = out.join(rasters.select(F.col("path").alias("raster"), "affine", *([] if srid is None else [F.col("srid").alias("raster_srid")])), "raster")
    out = out.withColumn("ring", ring if srid is None else geometry.reproject_ring(ring, srid, F.col("raster_srid"))).withColumn("bounds", geometry.ring_bounds(F.col("ring")))
    out = out.withColumn("window", geometry.pixel_window(F.col("bounds"), F.col("affine"))).withColumn("padded_window", geometry.pixel_window(geometry.padded(F.col("bounds")), F.col("affine")))
    out = out.withColumn("transform", geometry.window_transform(F.col("affine"), F.col("window.row0"), F.col("window.col0")))
    return out.select(F.col("fid").alias("polygon_index"), "class", labels.class_name(F.col("class")).alias("class_name"), "bounds", "window", "padded_window", "transform", "polygon_points")


def metrics(summary: DataFrame, images: DataFrame, names: Sequence[str], size: tuple[int, int] = (100, 100)) -> DataFrame:
    """id, class and a column a metric of every record whose image exists, at a common size (w, h)."""
    w, h = size
    records = summary.select("id", F.col("class_text").alias("class"), labels.stem(F.col("file")).alias("stem"))
    seen = records.join(images.select(labels.stem(F.col("path")).alias("stem"), "v", "h", "w"), "stem")
    small = seen.select("id", "class", pixels.resized(F.col("v"), F.col("h"), F.col("w"), F.lit(h), F.lit(w), "bilinear").alias("v"), F.lit(h).alias("h"), F.lit(w).alias("w"))
    return texture.with_metrics(small, list(names)).select("id", "class", *texture.known_metrics(list(names))[0])


def crops(images: DataFrame, strategy: str, n: int = 10, window: int = 256, stride: object = None, threshold: float = 0.1, seed: int = 0, ring: str | None = None, area: str | None = None) -> DataFrame:
    """The crop manifest of a strategy: crop_id, source_image_id, crop_index, window_size, x0.., mask_coverage.

    `polygon` keeps windows that overlap the ring column and falls back to the grid for images without a ring. crop_index
    counts an image's crops from 0; crop_id is the `area` column where one is given, the image (four digits) and the index (three).
    """
    if strategy not in grids.STRATEGIES:
        raise ValueError(f"strategies are {sorted(grids.STRATEGIES)}")
    if strategy == "random":
        at = grids.random_centres(images, "image_id", n, seed)
    elif strategy == "fixed" or ring is None:
        at = grids.fixed_grid(images, window, n, stride)
    else:
        plain = grids.fixed_grid(images.where(F.col(ring).isNull()), window, n, stride)  # the first n, as without rings
        cells = grids.fixed_grid(images.where(F.col(ring).isNotNull()), window, n, stride, whole=True)  # n of those that pass are chosen below
        hit = geometry.crop_overlaps(F.col(ring), F.col("cx"), F.col("cy"), window, threshold)
        chosen = grids.uniform_subsample(cells.where(hit), "image_id", ["ord"], n)
        count = F.row_number().over(W.partitionBy("image_id").orderBy("ord")) - 1  # at most n rows an image
        at = chosen.withColumn("ord", count).unionByName(plain)
    image = F.format_string("%04d", "image_id") if dict(images.dtypes)["image_id"] in ("tinyint", "smallint", "int", "bigint") else F.col("image_id").cast("string")
    out = grids.crop_windows(at, window)
    out = out.withColumn("crop_id", F.concat_ws("_", *([] if area is None else [F.col(area)]), image, F.format_string("%03d", "ord")))
    return out.select("crop_id", F.col("image_id").alias("source_image_id"), F.col("ord").alias("crop_index"), F.lit(window).alias("window_size"), "x0", "y0", "x1", "y1", F.col("coverage").alias("mask_coverage"), F.lit(grids.stride_label(stride)).alias("stride"))


def crop_batch(images: DataFrame, strategy: str, windows: Sequence[int] = (256,), strides: Sequence[object] = (None,), noises: Sequence[str] = ("gaussian", "uniform"), levels: Sequence[float] = (0.0, 0.1, 0.2), **options) -> DataFrame:
    """All configurations as one plan: manifests by window and stride, crossed with the few noise settings in place."""
    out = None
    for w in windows:
        for s in strides:
            one = crops(images, strategy, window=w, stride=s, **options)
            out = one if out is None else out.unionByName(one)
    noise = F.array(*[F.struct(F.lit(k).alias("noise_type"), F.lit(float(x)).alias("noise_level")) for k in noises for x in levels])
    return out.withColumn("_n", F.explode(noise)).select(*out.columns, "_n.*")


def crop_pixels(manifest: DataFrame, images: DataFrame, window: int, level: float | None = None, kind: str = "gaussian", seed: int = 0) -> DataFrame:
    """The manifest with v and mask of each crop; pixels off the image are filled where `level` is given."""
    image, cut = grids.free("_image", manifest), grids.free("_cut", manifest)
    src = images.select(F.col("image_id").alias("source_image_id"), F.struct("v", "h", "w").alias(image))
    out = manifest.join(src, "source_image_id").withColumn(cut, pixels.crop(F.col(image)["v"], F.col(image)["h"], F.col(image)["w"], F.col("x0"), F.col("y0"), window))
    out = out.withColumn("v", F.col(cut)["v"]).withColumn("mask", F.col(cut)["mask"]).drop(image, cut)
    if level is None:
        return out
    return out.withColumn("v", pixels.noise_fill(F.col("v"), F.col("mask"), F.col("crop_id"), level, kind, seed, F.lit(window)))


def resize(images: DataFrame, scales: DataFrame, done: DataFrame | None = None, kind: str = "chebyshev") -> DataFrame:
    """Images of areas with a scale, resized by it (half-even sizes); those in `done` are skipped."""
    todo = images if done is None else lookups.not_done(images, done, "image_id")
    high, wide = grids.free("_h", todo), grids.free("_w", todo)
    out = lookups.with_scale(todo, scales).withColumn(high, F.rint(F.col("h") * F.col("scale")).cast("int")).withColumn(wide, F.rint(F.col("w") * F.col("scale")).cast("int"))
    out = out.withColumn("v", pixels.resized(F.col("v"), F.col("h"), F.col("w"), F.col(high), F.col(wide), kind))
    return out.withColumn("h", F.col(high)).withColumn("w", F.col(wide)).drop(high, wide)


def patches(images: DataFrame, ring: str = "ring", size: int = grids.PATCH, step: int = grids.STEP, threshold: float = grids.OVERLAP) -> DataFrame:
    """Training patches with accepted, their pixels, and a name; write with partitionBy("accepted")."""
    cut = lookups.judged_windows(images, ring, size, step, threshold)
    name = F.concat(F.col("image_id").cast("string"), F.format_string("_%03d_%03d", "i", "j"))
    return cut.withColumn("patch", pixels.crop(F.col("v"), F.col("h"), F.col("w"), F.col("x0"), F.col("y0"), size)["v"]).withColumn("name", name).drop("v")


def augmented(patches_: DataFrame, size: int = grids.PATCH, copies: int = 3, seed: int = 0) -> DataFrame:
    """`copies` random variants of each accepted patch."""
    rows = patches_.where("accepted").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    return rows.withColumn("patch", pixels.augment(F.col("patch"), F.lit(size), F.lit(size), F.col("name"), F.col("copy"), seed))


def size_analysis(summary: DataFrame, by: Column) -> DataFrame:
    """Size statistics of class 1 by area, from records as `read_summaries` gives them."""
    rows = summary.where("class = 1").select(by.alias("area"), "width_m", "height_m", "area_m2", F.col("image_shape.width").alias("w_px"), F.col("image_shape.height").alias("h_px"))
    return stats.size_statistics(rows, "area")


def comparison(images: DataFrame, scale: float, zoom: int = 200) -> DataFrame:
    """Zoom regions of each image and its resized size, with pixels by three methods of resizing."""
    h, w = (F.rint(F.col(c) * scale).cast("int") for c in ("h", "w"))
    out = grids.zoom_on_scaled(grids.zoom_region(images, zoom).withColumn("scaled_h", h).withColumn("scaled_w", w), "scaled_w", "scaled_h")
    for kind in ("chebyshev", "bicubic", "spline"):
        out = out.withColumn(kind, pixels.resized(F.col("v"), F.col("h"), F.col("w"), F.col("scaled_h"), F.col("scaled_w"), kind))
    return out.drop("v")
