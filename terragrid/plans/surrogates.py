"""Images, sizes, polygons and file lists built from the test tables by fixed rules (FIXTURES.md C), and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCALES = [("AFRICA", 0.886), ("ASIA", 0.218), ("EUROPE", 0.18)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, d: str) -> DataFrame:
    """image_id, class, v array<double>, h, w: 8 x 8 pixels."""
    level = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127.5).cast("double"))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("label").alias("class"), level.alias("v"), F.lit(8).alias("h"), F.lit(8).alias("w"))


PX = """px AS (SELECT vec_id AS image_id, label AS class, ((i - 1) // 8)::INT AS r, ((i - 1) % 8)::INT AS c,
  floor((embedding[i]::DOUBLE + 1) * 127.5) AS v FROM embeddings, range(1, 65) t(i))"""
#: Horizontal neighbours, and all rook neighbours once each.
HP = "hp AS (SELECT a.image_id, a.class, a.v AS a, b.v AS b FROM px a JOIN px b ON a.image_id = b.image_id AND a.r = b.r AND b.c = a.c + 1)"
RP = "rp AS (SELECT a.image_id, a.v AS a, b.v AS b FROM px a JOIN px b ON a.image_id = b.image_id AND ((a.r = b.r AND b.c = a.c + 1) OR (a.c = b.c AND b.r = a.r + 1)))"


def sizes(spark: SparkSession, d: str) -> DataFrame:
    """area, class, width_m, height_m, area_m2, w_px, h_px."""
    t = lambda name: table(spark, d, name)
    areas = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", F.col("r_name").alias("area"))
    parts = t("part").select("p_partkey", "p_size")
    lines = t("lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    out = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(areas, F.col("l_suppkey") == F.col("s_suppkey"))
    width = F.col("l_quantity") * F.col("l_extendedprice") / 1000
    height = F.col("width_m") * F.col("l_quantity") / 50
    out = out.withColumn("width_m", width).withColumn("height_m", height).withColumn("area_m2", F.col("width_m") * F.col("height_m"))
    return out.select("area", (1 + F.col("p_size") % 3).alias("class"), "width_m", "height_m", "area_m2", (100 + F.col("p_size") * 8).alias("w_px"), (100 + F.col("l_suppkey") % 50).cast("int").alias("h_px"))


SIZES = """sizes AS (SELECT r_name AS area, 1 + p_size % 3 AS class, width_m, width_m * l_quantity / 50 AS height_m, width_m * (width_m * l_quantity / 50) AS area_m2,
  100 + p_size * 8 AS w_px, (100 + l_suppkey % 50)::INT AS h_px FROM (SELECT *, l_quantity * l_extendedprice / 1000 AS width_m FROM lineitem)
  JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def dims(spark: SparkSession, d: str) -> DataFrame:
    """image_id, class, w, h."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("image_id"), (1 + F.col("p_size") % 3).alias("class"), (224 + F.col("p_size") * 16).alias("w"), (224 + F.col("p_partkey") % 400).cast("int").alias("h"))


DIMS = "dims AS (SELECT p_partkey AS image_id, 1 + p_size % 3 AS class, 224 + p_size * 16 AS w, (224 + p_partkey % 400)::INT AS h FROM part)"


def rects(spark: SparkSession, d: str) -> DataFrame:
    """image_id, b struct<minx, miny, maxx, maxy>, ring (closed) of rectangles."""
    p = table(spark, d, "part")
    x0, y0 = (F.col("p_partkey") % 50).cast("double"), F.col("p_size").cast("double")
    b = F.struct(x0.alias("minx"), y0.alias("miny"), (x0 + 150 + F.col("p_size") * 4).alias("maxx"), (y0 + 150 + F.col("p_partkey") % 200).alias("maxy"))
    out = p.select(F.col("p_partkey").alias("image_id"), b.alias("b"))
    corner = lambda x, y: F.array(F.col(f"b.{x}"), F.col(f"b.{y}"))
    return out.withColumn("ring", F.array(corner("minx", "miny"), corner("maxx", "miny"), corner("maxx", "maxy"), corner("minx", "maxy"), corner("minx", "miny")))


RECTS = """rects AS (SELECT p_partkey AS image_id, x0, y0, x0 + 150 + p_size * 4 AS x1, y0 + 150 + p_partkey % 200 AS y1
  FROM (SELECT *, (p_partkey % 50)::DOUBLE AS x0, p_size::DOUBLE AS y0 FROM part))"""


def files(spark: SparkSession, d: str) -> DataFrame:
    """key, path, class: one image file an order."""
    area = F.element_at(F.array(*map(F.lit, ("Unita", "lluta", "chug", "other", "chugchug", "GranLlama", "salvador"))), (F.col("o_custkey") % 7 + 1).cast("int"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.format_string("dir/%s_%04d_ortho.jpg", area, "o_orderkey").alias("path"), (F.col("o_orderkey") % 5).cast("int").alias("class"))


FILES = """files AS (SELECT o_orderkey AS key, 'dir/' || ['Unita', 'lluta', 'chug', 'other', 'chugchug', 'GranLlama', 'salvador'][o_custkey % 7 + 1] || '_' || lpad(o_orderkey::VARCHAR, greatest(4, len(o_orderkey::VARCHAR))::INT, '0') || '_ortho.jpg' AS path,
  (o_orderkey % 5)::INT AS class FROM orders)"""
