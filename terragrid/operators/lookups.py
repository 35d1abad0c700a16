"""Joins and lookups of images, metadata, catalogs and labels.

No side is broadcast by hand: Spark does so where a side's size allows it, and sorts and merges beyond that. Null keys
match nothing; left rows with null keys stay in left joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terragrid.functions import geometry, labels
from terragrid.operators import grids
from terragrid.operators.grids import free


def with_class_names(df: DataFrame, classes: DataFrame, code: str = "class", default: str = "unknown") -> DataFrame:
    """`df` and class_name, from (code, name); codes that are not listed get the default."""
    key, name = free("_code", df), free("_name", df)
    named = classes.select(F.col("code").alias(key), F.col("name").alias(name))
    return df.join(named, F.col(code) == F.col(key), "left").withColumn("class_name", F.coalesce(name, F.lit(default))).drop(key, name)


def with_scale(df: DataFrame, scales: DataFrame, area: str = "area") -> DataFrame:
    """The rows whose area (in any case) has a scale, with it."""
    key, value = free("_area", df), free("_scale", df)
    named = scales.select(F.lower("area").alias(key), F.col("scale").alias(value))
    return df.join(named, F.lower(area) == F.col(key)).withColumn("scale", F.col(value)).drop(key, value)


def with_metadata(images: DataFrame, metadata: DataFrame, path: str = "path", file: str = "file") -> DataFrame:
    """Images left-joined with the metadata whose file is `<stem>_metadata.json`, `_ortho` being dropped from the stem."""
    key = free("_key", images, metadata)
    keyed = metadata.withColumn(key, F.regexp_replace(labels.stem(F.col(file)), "_metadata$", "")).drop(file)
    return images.withColumn(key, labels.metadata_key(F.col(path))).join(keyed, key, "left").drop(key)


def present(df: DataFrame, listing: DataFrame, key: str) -> DataFrame:
    """The rows whose file is in the listing."""
    return df.join(listing.select(key), key, "left_semi")


def not_done(df: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """The rows without an output yet."""
    return df.join(outputs.select(key), key, "left_anti")


def paired(originals: DataFrame, resized: DataFrame, keys: Sequence[str] = ("area", "file")) -> DataFrame:
    """Originals with their resized image (columns prefixed by resized_); an original without one is an error."""
    found = free("_found", originals)
    other = resized.select(*keys, *[F.col(c).alias(f"resized_{c}") for c in resized.columns if c not in keys], F.lit(True).alias(found))
    out = originals.join(other, list(keys), "left")
    check = F.assert_true(F.col(found).isNotNull(), F.concat(F.lit("no resized image for "), F.concat_ws("/", *keys)))
    return out.where(check.isNull()).drop(found)


def look_up(catalog: DataFrame, name: str, col: str = "name") -> DataFrame:
    """The entry of a name, in any case; ValueError if there is none. One row reaches the driver as a test."""
    out = catalog.where(F.lower(col) == name.lower())
    if out.isEmpty():
        raise ValueError(f"unknown area: {name}")
    return out


def list_catalog(catalog: DataFrame, every: bool = False) -> DataFrame:
    return catalog if every else catalog.where("geos_dir IS NOT NULL")


def image_path(files: Column, kind: str) -> Column:
    """The path of `kind` in a map of files, else the overlay's, else the ortho image's; an error if there is none."""
    path = F.coalesce(files[f"{kind}_jpeg"], files["overlay_jpeg"], files["ortho_jpeg"])
    return F.when(path.isNull(), F.raise_error(F.lit("no image file")).cast("string")).otherwise(path)


def tile_join(polygons: DataFrame, tiles: DataFrame, bounds: str, size: float) -> DataFrame:
    """Polygons with the raster tiles (tx, ty, ...) that their bounds touch: an equi-join on tile ids, not a range join."""
    tile = free("_t", polygons)
    return polygons.withColumn(tile, F.explode(geometry.tile_ids(F.col(bounds), size))).select("*", f"{tile}.tx", f"{tile}.ty").drop(tile).join(tiles, ["tx", "ty"])


def judged_patches(patches: DataFrame, ring: str, threshold: float = 0.8, valid: str | None = None) -> DataFrame:
    """Adds accepted: whether the window overlaps the ring enough; images without a ring accept all their patches. `valid`
    names a column that tells whether the ring is valid; without it each patch's ring is judged anew."""
    hit = geometry.overlaps_at_least(F.col(ring), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), threshold, None if valid is None else F.col(valid))
    return patches.withColumn("accepted", F.when(F.col(ring).isNull(), True).otherwise(hit))


def judged_windows(images: DataFrame, ring: str, size: int, step: int, threshold: float = 0.8, w: str = "w", h: str = "h") -> DataFrame:
    """The sliding patches of images with accepted: a ring is judged once an image, before its windows are made, and windows
    beside the ring's bounds are turned down without a look at its points."""
    valid, bounds = free("valid", images), free("bounds", images)
    judged = images.withColumn(valid, geometry.valid_polygon(F.col(ring))).withColumn(bounds, geometry.ring_bounds(F.col(ring)))
    b = F.col(bounds)
    out = grids.sliding_patches(judged, size, step, w, h)
    meets = (b["minx"] < F.col("x1")) & (b["maxx"] > F.col("x0")) & (b["miny"] < F.col("y1")) & (b["maxy"] > F.col("y0"))
    covers = (b["maxx"] - b["minx"]) * (b["maxy"] - b["miny"]) >= threshold * float(size) ** 2  # bounds too small for any window
    hit = F.coalesce(F.when(F.col(valid) & meets & covers, geometry.overlaps_at_least(F.col(ring), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), threshold, F.lit(True))), F.lit(threshold <= 0) & F.col(valid))
    return out.withColumn("accepted", F.when(F.col(ring).isNull(), True).otherwise(F.coalesce(hit, F.lit(False)))).drop(valid, bounds)


def rectangle_overlap(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Area that two boxes (x0, y0, x1, y1) share, by plain arithmetic."""
    side = lambda i: F.greatest(F.lit(0), F.least(a[i + 2], b[i + 2]) - F.greatest(a[i], b[i]))
    return side(0) * side(1)


def class_filter(df: DataFrame, code: int | None, limit: int | None = None, order: str = "fid") -> DataFrame:
    """The first `limit` rows by `order`, of which those of a class: the limit comes first."""
    if code is not None and code not in labels.CLASS_NAMES:
        raise ValueError("classes are 1, 2 and 3")
    out = df if limit is None else df.orderBy(order).limit(limit)
    return out if code is None else out.where(F.col("class") == code)


def rescaled_metadata(df: DataFrame, scale: Column) -> DataFrame:
    """Metadata after resizing: image_shape scaled (half to even), resized, scale_factor, file_size_mb by scale squared."""
    side = lambda c: F.rint(F.col(f"image_shape.{c}") * scale).cast("int")
    out = df.withColumn("image_shape", F.col("image_shape").withField("height", side("height")).withField("width", side("width")))
    out = out.withColumn("resized", F.lit(True)).withColumn("scale_factor", scale)
    return out.withColumn("file_size_mb", F.col("file_size_mb") * scale * scale) if "file_size_mb" in df.columns else out
