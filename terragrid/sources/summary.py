"""Polygon metadata: area summaries (JSON with an array of records) and single records, as flat rows; sinks for both.

Both envelopes are read: `polygons` (polygon_index, files) and `metadata` (geoglyph_id, filename). Fields that occur in
several types are read as text and parsed on: class (number or word), bbox_size_meters (object or list). Missing fields
are null; `strict` makes a malformed file an error, otherwise it gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terragrid.functions import geometry

RECORD = """polygon_index bigint, geoglyph_id bigint, class string, filename string,
bounds struct<minx: double, miny: double, maxx: double, maxy: double>, bbox_size_meters string, crs string,
polygon_points array<struct<exterior: array<array<double>>, interiors: array<array<array<double>>>>>,
polygon array<array<double>>, geometry struct<coordinates: array<array<array<double>>>>, coordinates array<array<double>>,
polygon_coords array<array<double>>, image_shape struct<height: int, width: int, channels: int>,
files map<string, string>, resized boolean, scale_factor double, file_size_mb double"""
_SIZES = ("width_m", "height_m", "area_m2")


def _flat(r: Column) -> list[Column]:
    sizes = F.from_json(r["bbox_size_meters"], "struct<width_m: double, height_m: double, area_m2: double>")
    listed = F.from_json(r["bbox_size_meters"], "array<double>")
    is_list = F.coalesce(r["bbox_size_meters"].startswith("["), F.lit(False))
    ring = F.coalesce(geometry.first_ring(r["polygon_points"], r["polygon"], r["geometry"]["coordinates"], r["coordinates"]), r["polygon_coords"])
    return [
        F.coalesce(r["geoglyph_id"], r["polygon_index"]).alias("id"),
        F.coalesce(r["class"], F.lit("unknown")).alias("class_text"),
        r["class"].try_cast("int").alias("class"),
        F.coalesce(r["filename"], r["files"]["ortho_jpeg"]).alias("file"),
        r["files"].alias("files"),
        r["bounds"].alias("bounds"),
        *[F.when(is_list, F.get(listed, F.lit(i))).otherwise(sizes[c]).alias(c) for i, c in enumerate(_SIZES)],
        r["crs"].alias("crs"),
        ring.alias("ring"),
        r["image_shape"].alias("image_shape"),
        r["scale_factor"].alias("scale_factor"),
        r["file_size_mb"].alias("file_size_mb"),
    ]


def read_summaries(spark: SparkSession, path: str | list[str], strict: bool = False) -> DataFrame:
    """source (the file) and one row a record of each summary."""
    schema = f"total_polygons bigint, processed_polygons bigint, output_directory string, polygons array<struct<{_nested(RECORD)}>>, metadata array<struct<{_nested(RECORD)}>>"
    docs = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path, multiLine=True)
    rows = docs.select(F.col("_metadata.file_path").alias("source"), F.explode(F.concat(*[F.coalesce(F.col(c), F.array().cast(f"array<struct<{_nested(RECORD)}>>")) for c in ("polygons", "metadata")])).alias("r"))
    return rows.select("source", *_flat(F.col("r")))


def read_records(spark: SparkSession, path: str | list[str], strict: bool = False) -> DataFrame:
    """source and one row a file of single records."""
    docs = spark.read.schema(RECORD).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path, multiLine=True, pathGlobFilter="*.json", recursiveFileLookup=True)
    return docs.select(F.col("_metadata.file_path").alias("source"), F.struct(*docs.columns).alias("r")).select("source", *_flat(F.col("r")))


def _nested(ddl: str) -> str:
    """A column list as the inside of a struct: `a int, b string` -> `a: int, b: string` at the outer level."""
    out, depth, name = [], 0, True
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            name = True
        if ch == " " and name and depth == 0 and out and out[-1].isalnum():
            out.append(":")
            name = False
        out.append(ch)
    return "".join(out)


def write_records(df: DataFrame, path: str, by: str = "area") -> None:
    """One JSON row a record, in folders by `by`."""
    df.write.partitionBy(by).json(path)


def summaries(df: DataFrame, by: str = "area", order: str = "polygon_index") -> DataFrame:
    """by, total_polygons, processed_polygons, polygons: one envelope an area, records in order.

    An envelope is one document, so an area's records meet in one row: meant for hand-labelled layers. `write_records`
    has no such bound.
    """
    rest = [c for c in df.columns if c != by]
    got = F.sort_array(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*rest).alias("r"))))
    return df.groupBy(by).agg(F.count("*").alias("total_polygons"), F.count(order).alias("processed_polygons"), F.transform(got, lambda x: x["r"]).alias("polygons"))


def write_csv(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """A result table as CSV with a header, in folders by the columns `by`."""
    (df.write.partitionBy(*by) if by else df.write).option("header", True).csv(path)
