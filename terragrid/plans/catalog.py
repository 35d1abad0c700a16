"""Every registered query of the imagery engine, with SQL that an independent engine runs on the same tables.

Doubles are rounded on both sides (`+ 0` makes a negative zero positive). Queries without SQL are tested against numpy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terragrid.functions import geometry, labels, measures, packed, pixels, texture
from terragrid.operators import grids, lookups, stats
from terragrid.plans import extraction, pipelines
from terragrid.plans.surrogates import DIMS, FILES, HP, PX, RECTS, RP, SCALES, SIZES, dims, files, images, rects, sizes, table
from terragrid.sources import geotiff

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def R(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


def query(sql: str | None = None, digits: int = 6) -> Callable[[Query], Query]:
    """Registers a function (spark, sf_dir) -> DataFrame under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = lambda s, d: rounded(f(s, d), digits)
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _metric(name: str, sql: str | None, build: Callable[[Column, Column, Column], Column]) -> None:
    QUERIES[name] = lambda s, d: rounded(images(s, d).select("image_id", build(F.col("v"), F.col("h"), F.col("w")).alias("value")))
    if sql:
        ORACLES[name] = sql


# Lattice and texture metrics -----------------------------------------------------------------------------------------

_MORAN = """z AS (SELECT *, v - avg(v) OVER (PARTITION BY image_id) AS z FROM px),
nb AS (SELECT a.image_id, a.class, a.r, a.c, a.z, avg(b.z) AS lag FROM z a JOIN z b ON a.image_id = b.image_id AND {near} GROUP BY ALL),
moran AS (SELECT image_id, any_value(class) AS class, sum(z * lag) / nullif(sum(z * z), 0) AS moran FROM nb GROUP BY image_id)"""
_ROOK, _QUEEN = (_MORAN.format(near=x) for x in ("abs(a.r - b.r) + abs(a.c - b.c) = 1", "greatest(abs(a.r - b.r), abs(a.c - b.c)) = 1"))
_ENTROPY = """e AS (SELECT image_id, least(min(a), min(b)) AS lo, greatest(max(a), max(b)) AS hi, count(*) AS n FROM rp GROUP BY 1),
k AS (SELECT e.image_id, least(255, floor((a - lo) * 256 / (hi - lo))) AS x, least(255, floor((b - lo) * 256 / (hi - lo))) AS y, any_value(n) AS n, count(*) AS m
  FROM rp JOIN e ON rp.image_id = e.image_id WHERE hi > lo GROUP BY 1, 2, 3),
entropy AS (SELECT e.image_id, coalesce(-sum(m / k.n * log2(m / k.n)), 0) AS entropy FROM e LEFT JOIN k ON e.image_id = k.image_id GROUP BY 1)"""
_GLCM = """glcm AS (SELECT image_id, any_value(class) AS class, avg((a - b) * (a - b)) AS contrast, avg(1 / (1 + (a - b) * (a - b))) AS homogeneity,
  coalesce((avg(a * b) - pow(avg(a + b) / 2, 2)) / nullif(avg(a * a + b * b) / 2 - pow(avg(a + b) / 2, 2), 0), 1) AS correlation FROM hp GROUP BY image_id)"""
_ENERGY = """sym AS (SELECT image_id, a, b FROM hp UNION ALL SELECT image_id, b, a FROM hp),
energy AS (SELECT image_id, sqrt(sum(pow(m / n, 2))) AS energy FROM (SELECT image_id, count(*) AS m, sum(count(*)) OVER (PARTITION BY image_id) AS n FROM sym GROUP BY image_id, a, b) GROUP BY image_id)"""
_HU = """m AS (SELECT *, sum(v * r) OVER w / sum(v) OVER w AS mr, sum(v * c) OVER w / sum(v) OVER w AS mc FROM px WINDOW w AS (PARTITION BY image_id)),
hu AS (SELECT image_id, log10(abs(sum(v * (pow(r - mr, 2) + pow(c - mc, 2)))) + 1e-10) AS hu FROM m GROUP BY image_id)"""

_metric("moran_by_image", f"WITH {PX}, {_ROOK} SELECT image_id, {R('moran')} AS value FROM moran", texture.moran)
_metric("moran_queen", f"WITH {PX}, {_QUEEN} SELECT image_id, {R('moran')} AS value FROM moran", lambda v, h, w: texture.moran(v, h, w, "queen"))
_metric("spatial_entropy", f"WITH {PX}, {RP}, {_ENTROPY} SELECT image_id, {R('entropy')} AS value FROM entropy", texture.spatial_entropy)
_metric("glcm_contrast", f"WITH {PX}, {HP}, {_GLCM} SELECT image_id, {R('contrast')} AS value FROM glcm", texture.contrast)
_metric("glcm_homogeneity", f"WITH {PX}, {HP}, {_GLCM} SELECT image_id, {R('homogeneity')} AS value FROM glcm", texture.homogeneity)
_metric("glcm_energy", f"WITH {PX}, {HP}, {_ENERGY} SELECT image_id, {R('energy')} AS value FROM energy", texture.energy)
_metric("glcm_correlation", f"WITH {PX}, {HP}, {_GLCM} SELECT image_id, {R('correlation')} AS value FROM glcm", texture.correlation)
_metric("hu_log", f"WITH {PX}, {_HU} SELECT image_id, {R('hu')} AS value FROM hu", texture.hu_log)
_HOG = """g AS (SELECT p.image_id, p.r // 4 * 2 + p.c // 4 AS cell, CASE WHEN p.r BETWEEN 1 AND 6 THEN d.v - u.v ELSE 0 END AS gy, CASE WHEN p.c BETWEEN 1 AND 6 THEN n.v - m.v ELSE 0 END AS gx FROM px p
  LEFT JOIN px u ON u.image_id = p.image_id AND u.r = p.r - 1 AND u.c = p.c LEFT JOIN px d ON d.image_id = p.image_id AND d.r = p.r + 1 AND d.c = p.c
  LEFT JOIN px m ON m.image_id = p.image_id AND m.r = p.r AND m.c = p.c - 1 LEFT JOIN px n ON n.image_id = p.image_id AND n.r = p.r AND n.c = p.c + 1),
hist AS (SELECT image_id, cell, least(8, floor((degrees(atan2(gy, gx)) % 180 + 180) % 180 / 20)) AS o, sum(sqrt(gx * gx + gy * gy)) / 16 AS m FROM g GROUP BY ALL),
cut AS (SELECT image_id, cell, least(0.2, m / sqrt(sum(m * m) OVER (PARTITION BY image_id, cell) + 1e-10)) AS m FROM hist),
hog AS (SELECT image_id, sum(k) / 36 AS hog FROM (SELECT image_id, m * m / (sum(m * m) OVER (PARTITION BY image_id, cell) + 1e-10) AS k FROM cut) GROUP BY 1)"""
_LBP = """b AS (SELECT p.image_id, p.r, p.c, k, (CASE WHEN (CASE WHEN dr = 0 OR dc = 0 THEN coalesce(e.v, 0) ELSE 0.29289 * 0.29289 * p.v + 0.29289 * 0.70711 * (coalesce(a.v, 0) + coalesce(z.v, 0)) + 0.70711 * 0.70711 * coalesce(e.v, 0) END) - p.v >= -1e-9 THEN 1 ELSE 0 END) AS bit
  FROM px p CROSS JOIN (VALUES (0, 0, 1), (1, -1, 1), (2, -1, 0), (3, -1, -1), (4, 0, -1), (5, 1, -1), (6, 1, 0), (7, 1, 1)) t(k, dr, dc) LEFT JOIN px e ON e.image_id = p.image_id AND e.r = p.r + dr AND e.c = p.c + dc
  LEFT JOIN px a ON a.image_id = p.image_id AND a.r = p.r + dr AND a.c = p.c LEFT JOIN px z ON z.image_id = p.image_id AND z.r = p.r AND z.c = p.c + dc),
codes AS (SELECT image_id, CASE WHEN count(*) FILTER (bit <> after) <= 2 THEN sum(bit) ELSE 9 END AS code FROM (SELECT *, coalesce(lead(bit) OVER w, first_value(bit) OVER w) AS after FROM b WINDOW w AS (PARTITION BY image_id, r, c ORDER BY k)) GROUP BY image_id, r, c),
lbp AS (SELECT image_id, -sum(n / 64.0 * ln(n / 64.0)) AS lbp FROM (SELECT image_id, code, count(*) AS n FROM codes GROUP BY ALL) GROUP BY 1)"""

_metric("hog_energy", f"WITH {PX}, {_HOG} SELECT image_id, {R('hog')} AS value FROM hog", lambda v, h, w: measures.measured(v, h, w, ["hog"], cell=4)["hog"])
_metric("lbp_entropy", f"WITH {PX}, {_LBP} SELECT image_id, {R('lbp')} AS value FROM lbp", lambda v, h, w: measures.measured(v, h, w, ["lbp_entropy"])["lbp_entropy"])

_WIDE = ["moran", "entropy", "contrast", "homogeneity", "energy", "correlation", "humoments"]
_SOME = ["moran", "contrast", "homogeneity"]
_SOME_SQL = f"{PX}, {_ROOK}, {HP}, {_GLCM}, t AS (SELECT m.image_id, m.class, moran, contrast, homogeneity FROM moran m JOIN glcm g ON m.image_id = g.image_id)"


def _some(s: SparkSession, d: str) -> DataFrame:
    return texture.with_metrics(images(s, d), _SOME).select("image_id", "class", *_SOME)


@query(f"""WITH {PX}, {_ROOK}, {RP}, {_ENTROPY}, {HP}, {_GLCM}, {_ENERGY}, {_HU} SELECT m.image_id, m.class, {", ".join(f"{R(c)} AS {n}" for n, c in zip(_WIDE, (*_WIDE[:6], "hu")))}
FROM moran m JOIN entropy e ON m.image_id = e.image_id JOIN glcm g ON m.image_id = g.image_id JOIN energy y ON m.image_id = y.image_id JOIN hu ON m.image_id = hu.image_id""")
def texture_wide(s: SparkSession, d: str) -> DataFrame:
    return texture.with_metrics(images(s, d), _WIDE).drop("v", "h", "w")


@query(f"WITH {_SOME_SQL} SELECT class, count(*) AS n, {', '.join(f'{R(f"avg({c})")} AS {c}' for c in _SOME)} FROM t GROUP BY class")
def texture_by_class(s: SparkSession, d: str) -> DataFrame:
    return _some(s, d).groupBy("class").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in _SOME])


@query(f"""WITH {_SOME_SQL}, u AS (UNPIVOT t ON {", ".join(_SOME)} INTO NAME metric VALUE x) SELECT metric, count(x) AS n, {R("avg(x)")} AS mean, {R("stddev_samp(x)")} AS std,
{R("min(x)")} AS min, {R("quantile_cont(x, 0.25)")} AS q25, {R("quantile_cont(x, 0.5)")} AS q50, {R("quantile_cont(x, 0.75)")} AS q75, {R("max(x)")} AS max FROM u GROUP BY metric""")
def describe_metrics(s: SparkSession, d: str) -> DataFrame:
    return stats.describe(_some(s, d), _SOME)


@query(f"""WITH {_SOME_SQL}, p AS ({" UNION ALL ".join(f"SELECT image_id, class = 1 AS is_first, '{a}' AS x_metric, '{b}' AS y_metric, {R(a)} AS x, {R(b)} AS y FROM t" for a, b in (("moran", "contrast"), ("moran", "homogeneity"), ("contrast", "homogeneity")))})
SELECT * FROM p""")
def metric_pairs(s: SparkSession, d: str) -> DataFrame:
    return stats.metric_pairs(_some(s, d), _SOME, "image_id", "class")


@query(f"WITH {_SOME_SQL} SELECT image_id, {', '.join(f'{R(c)} AS {c}' for c in _SOME)}, class = 1 AS is_first FROM t")
def scatter_split(s: SparkSession, d: str) -> DataFrame:
    return _some(s, d).select("image_id", *_SOME, (F.col("class") == 1).alias("is_first"))


@query(f"WITH {PX}, {RP} SELECT image_id, count(*) AS pairs, {R('avg(abs(a - b))')} AS mean_step FROM rp GROUP BY image_id")
def lattice_pairs(s: SparkSession, d: str) -> DataFrame:
    pairs = texture.neighbour_pairs(texture.pixels(images(s, d).drop("class")))
    return pairs.groupBy("image_id").agg(F.count("*").alias("pairs"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("mean_step"))


# Statistics ----------------------------------------------------------------------------------------------------------


def _hist_sql(source: str, by: str, x: str, bins: int) -> str:
    return f"""e AS (SELECT {by} AS g, min({x}) AS lo, max({x}) AS hi FROM {source} GROUP BY 1)
SELECT {by}, coalesce(least({bins - 1}, floor(({x} - lo) * {bins} / nullif(hi - lo, 0))), {bins // 2})::INT AS bin, count(*) AS n FROM {source} JOIN e ON {by} = g GROUP BY 1, 2"""


@query(f"WITH {SIZES}, {_hist_sql('sizes', 'class', 'width_m', 20)}")
def hist_by_class(s: SparkSession, d: str) -> DataFrame:
    return stats.histogram(sizes(s, d), "class", "width_m", 20)


@query(f"WITH {SIZES}, {_hist_sql('sizes', 'area', 'height_m', 15)}")
def hist_by_area(s: SparkSession, d: str) -> DataFrame:
    return stats.histogram(sizes(s, d), "area", "height_m", 15)


@query(f"""WITH q AS (SELECT event_type AS g, count(value) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
r AS (SELECT *, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM events JOIN q ON event_type = g WHERE value IS NOT NULL)
SELECT event_type, any_value(n) AS n, {R("any_value(q1)")} AS q1, {R("any_value(median)")} AS median, {R("any_value(q3)")} AS q3,
{R("min(value) FILTER (inside)")} AS whisker_low, {R("max(value) FILTER (inside)")} AS whisker_high, count(*) FILTER (NOT inside) AS fliers FROM r GROUP BY event_type""")
def box_by_class(s: SparkSession, d: str) -> DataFrame:
    return stats.box_plot(table(s, d, "events").select("event_type", "value"), "event_type", "value")


def _iqr_sql(col: str, name: str) -> str:
    q = f"quantile_cont({col}, 0.75) - quantile_cont({col}, 0.25)"
    return f"{name} AS (SELECT area AS {name}_area, quantile_cont({col}, 0.25) - 1.5 * ({q}) AS {name}_low, quantile_cont({col}, 0.75) + 1.5 * ({q}) AS {name}_high FROM sizes GROUP BY 1)"


_BOUNDS = ", ".join(_iqr_sql(c, k) for k, c in (("w", "width_m"), ("h", "height_m"), ("a", "area_m2")))


@query(f"WITH {SIZES}, {_iqr_sql('width_m', 'w')} SELECT area, count(*) AS n, {R('avg(width_m)', 4)} AS mean FROM sizes JOIN w ON area = w_area WHERE width_m BETWEEN w_low AND w_high GROUP BY area", 4)
def iqr_filtered_mean(s: SparkSession, d: str) -> DataFrame:
    return stats.remove_outliers(sizes(s, d), ["area"], "width_m").groupBy("area").agg(F.count("*").alias("n"), F.avg("width_m").alias("mean"))


_STATS = f"""{SIZES}, {_BOUNDS}, st AS (SELECT area, count(*) AS n, coalesce(avg((CASE WHEN w_px > 0 THEN width_m / w_px ELSE 0 END + CASE WHEN h_px > 0 THEN height_m / h_px ELSE 0 END) / 2), 0) AS m_per_px,
{", ".join(f"min({c}) AS {k}_min, max({c}) AS {k}_max, avg({c}) FILTER ({c} BETWEEN {k}_low AND {k}_high) AS {k}_mean, count(*) FILTER ({c} BETWEEN {k}_low AND {k}_high) AS {k}_kept" for k, c in (("w", "width_m"), ("h", "height_m"), ("a", "area_m2")))}
FROM sizes JOIN w ON area = w_area JOIN h ON area = h_area JOIN a ON area = a_area GROUP BY area),
wi AS (SELECT *, greatest(ceil(w_mean), ceil(h_mean))::BIGINT AS window_m, CASE WHEN m_per_px > 0 THEN ceil(greatest(ceil(w_mean), ceil(h_mean)) / m_per_px) ELSE 0 END::BIGINT AS window_px FROM st)"""


@query(f"WITH {_STATS} SELECT area, n, {R('m_per_px', 3)} AS m_per_px, {', '.join(f'{R(f"{k}_{m}", 3)} AS {k}_{m}' for k in 'wha' for m in ('min', 'max', 'mean'))}, w_kept, h_kept, a_kept, window_m, window_px FROM wi", 3)
def size_stats_by_area(s: SparkSession, d: str) -> DataFrame:
    return stats.size_statistics(sizes(s, d), "area")


@query(f"WITH {_STATS} SELECT area, {R('m_per_px', 4)} AS m_per_px FROM wi", 4)
def pixel_scale(s: SparkSession, d: str) -> DataFrame:
    return stats.size_statistics(sizes(s, d), "area").select("area", "m_per_px")


@query(f"WITH {_STATS} SELECT area, window_m, window_px FROM wi")
def suggested_window(s: SparkSession, d: str) -> DataFrame:
    return stats.size_statistics(sizes(s, d), "area").select("area", "window_m", "window_px")


@query(f"""WITH e AS (SELECT least(min(l_quantity), min(l_extendedprice)) AS lo, greatest(max(l_quantity), max(l_extendedprice)) AS hi FROM lineitem)
SELECT {R("lo - 0.05 * (hi - lo)", 4)} AS low, {R("hi + 0.05 * (hi - lo)", 4)} AS high FROM e""", 4)
def axis_limits(s: SparkSession, d: str) -> DataFrame:
    return stats.axis_limits(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice"])


@query(f"WITH {DIMS} SELECT class, count(*) AS n FROM dims GROUP BY class")
def value_counts(s: SparkSession, d: str) -> DataFrame:
    return stats.value_counts(dims(s, d), "class")


@query(f"WITH {DIMS} SELECT DISTINCT class FROM dims")
def distinct_classes(s: SparkSession, d: str) -> DataFrame:
    return dims(s, d).select("class").distinct()


@query(f"WITH {DIMS} SELECT count(*) FILTER (w >= 400) AS processed, count(*) FILTER (w < 400) AS skipped FROM dims")
def run_counters(s: SparkSession, d: str) -> DataFrame:
    return stats.status_counts(dims(s, d), F.col("w") >= 400)


# Filters, joins and labels -------------------------------------------------------------------------------------------


@query(f"WITH {SIZES} SELECT class, count(*) AS n, {R('sum(width_m)', 2)} AS width_m FROM sizes WHERE class = 1 GROUP BY class", 2)
def class_filter(s: SparkSession, d: str) -> DataFrame:
    return lookups.class_filter(sizes(s, d), 1).groupBy("class").agg(F.count("*").alias("n"), F.sum("width_m").alias("width_m"))


@query(f"WITH {DIMS} SELECT * FROM (SELECT * FROM dims ORDER BY image_id LIMIT 50) WHERE class = 2")
def limit_then_filter(s: SparkSession, d: str) -> DataFrame:
    return lookups.class_filter(dims(s, d), 2, limit=50, order="image_id")


_CLASSES = "classes AS (SELECT * FROM (VALUES (1, 'geo'), (2, 'ground'), (3, 'road')) t(code, name))"


@query(f"WITH {FILES}, {_CLASSES} SELECT key, class, coalesce(name, 'unknown') AS class_name FROM files LEFT JOIN classes ON class = code")
def class_name_join(s: SparkSession, d: str) -> DataFrame:
    names = s.createDataFrame(list(labels.CLASS_NAMES.items()), "code int, name string")
    return lookups.with_class_names(files(s, d), names).select("key", "class", "class_name")


@query(f"""WITH {SIZES}, scales AS (SELECT * FROM (VALUES {", ".join(f"('{a}', {x})" for a, x in SCALES)}) t(area, scale))
SELECT area, count(*) AS n, {R("max(scale)")} AS scale FROM sizes JOIN scales USING (area) GROUP BY area""")
def scale_join(s: SparkSession, d: str) -> DataFrame:
    scales = s.createDataFrame(SCALES, "area string, scale double")
    return lookups.with_scale(sizes(s, d), scales).groupBy("area").agg(F.count("*").alias("n"), F.max("scale").alias("scale"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 4)")
def already_done_anti(s: SparkSession, d: str) -> DataFrame:
    done = table(s, d, "lineitem").where("l_linenumber = 4").select(F.col("l_orderkey").alias("o_orderkey"))
    return lookups.not_done(table(s, d, "orders"), done, "o_orderkey").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 4)")
def file_semi(s: SparkSession, d: str) -> DataFrame:
    there = table(s, d, "lineitem").where("l_linenumber = 4").select(F.col("l_orderkey").alias("o_orderkey"))
    return lookups.present(table(s, d, "orders"), there, "o_orderkey").select("o_orderkey", "o_custkey")


@query(f"WITH {FILES} SELECT key, path, CASE WHEN key % 3 != 0 THEN key * 2 END AS polygon_index FROM files")
def metadata_left(s: SparkSession, d: str) -> DataFrame:
    img = files(s, d)
    meta = img.where("key % 3 != 0").select(F.replace("path", F.lit("_ortho.jpg"), F.lit("_metadata.json")).alias("file"), (F.col("key") * 2).alias("polygon_index"))
    return lookups.with_metadata(img, meta).select("key", "path", "polygon_index")


@query(f"WITH {FILES} SELECT key, CASE WHEN split_part(path, '/', 2) ILIKE 'unita\\_%' ESCAPE '\\' THEN 'unita' WHEN split_part(path, '/', 2) ILIKE 'lluta\\_%' ESCAPE '\\' THEN 'lluta' WHEN split_part(path, '/', 2) ILIKE 'chug\\_%' ESCAPE '\\' OR split_part(path, '/', 2) ILIKE 'chugchug\\_%' ESCAPE '\\' THEN 'chugchug' WHEN split_part(path, '/', 2) ILIKE 'granllama\\_%' ESCAPE '\\' THEN 'granllama' WHEN split_part(path, '/', 2) ILIKE 'salvador\\_%' ESCAPE '\\' THEN 'salvador' ELSE 'unknown' END AS area FROM files")
def area_from_filename(s: SparkSession, d: str) -> DataFrame:
    return files(s, d).select("key", labels.area_of_file(F.element_at(F.split("path", "/"), -1)).alias("area"))


@query("SELECT n_nationkey, lower(n_name) || '_' || lpad(n_nationkey::VARCHAR, 4, '0') || '.png' AS crop_id FROM nation")
def zero_pad_ids(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "nation").select("n_nationkey", labels.numbered(F.lower("n_name"), F.col("n_nationkey"), ".png").alias("crop_id"))


@query("SELECT p_partkey, p_size::INT AS x, CASE WHEN p_partkey % 2 = 0 THEN (p_partkey % 7 + 1)::INT ELSE p_size::INT END AS y FROM part")
def stride_label(s: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_size", F.lit("x"), (F.col("p_partkey") % 7 + 1).cast("string"))).otherwise(F.col("p_size").cast("string"))
    return table(s, d, "part").select("p_partkey", labels.stride_of(text).alias("t")).select("p_partkey", "t.x", "t.y")


@query("SELECT event_type, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS k, count(*) AS n FROM events GROUP BY event_type")
def json_props(s: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"]
    return table(s, d, "events").groupBy("event_type").agg(F.sum(k).alias("k"), F.count("*").alias("n"))


@query(f"WITH {DIMS} SELECT image_id, round_even(h * 0.218, 0)::INT AS height, round_even(w * 0.218, 0)::INT AS width, true AS resized, {R('0.218')} AS scale_factor, {R('w / 100 * 0.218 * 0.218')} AS file_size_mb FROM dims")
def rescale_metadata(s: SparkSession, d: str) -> DataFrame:
    meta = dims(s, d).select("image_id", F.struct(F.col("h").alias("height"), F.col("w").alias("width"), F.lit(3).alias("channels")).alias("image_shape"), (F.col("w") / 100).alias("file_size_mb"))
    return lookups.rescaled_metadata(meta, F.lit(0.218)).select("image_id", "image_shape.height", "image_shape.width", "resized", "scale_factor", "file_size_mb")


@query("""WITH asked AS (SELECT ['moran', 'sharpness', 'hog', 'blur', 'energy'][event_id % 5 + 1] AS metric FROM events)
SELECT metric, count(*) AS n FROM asked WHERE metric NOT IN ('moran', 'entropy', 'contrast', 'homogeneity', 'energy', 'correlation', 'humoments', 'hog', 'lbp_entropy') GROUP BY metric""")
def set_difference(s: SparkSession, d: str) -> DataFrame:
    asked = F.element_at(F.array(*map(F.lit, ("moran", "sharpness", "hog", "blur", "energy"))), (F.col("event_id") % 5 + 1).cast("int"))
    rows = table(s, d, "events").select(asked.alias("metric"))
    return rows.where(~F.col("metric").isin(list(texture.METRICS))).groupBy("metric").agg(F.count("*").alias("n"))


# Grids, crops and patches --------------------------------------------------------------------------------------------

_AUTO = f"""{DIMS}, g AS (SELECT *, greatest(1, ceil(sqrt(7 * (w / h))))::INT AS cols FROM dims), g2 AS (SELECT *, greatest(1, ceil(7 / cols))::INT AS nrows FROM g),
auto AS (SELECT image_id, class, w, h, ord::INT AS ord, round_even(128 + (ord % cols) * (greatest(128, w - 128) - 128) / greatest(1, cols - 1), 0)::INT AS cx,
round_even(128 + (ord // cols) * (greatest(128, h - 128) - 128) / greatest(1, nrows - 1), 0)::INT AS cy FROM g2, range(7) t(ord) WHERE ord < cols * nrows)"""
_STRIDE = f"""{DIMS}, g AS (SELECT *, ceil((greatest(w, 128) + 120 - 128) / 120)::INT AS cols, ceil((greatest(h, 128) + 90.0 - 128) / 90)::INT AS nrows FROM dims),
grid AS (SELECT image_id, class, w, h, (y * cols + x)::INT AS ord, (128 + x * 120)::INT AS cx, (128 + y * 90)::INT AS cy FROM g, range(64) a(x), range(64) b(y) WHERE x < cols AND y < nrows)"""
_COVER = """(greatest(0, least(cx + 128, w) - greatest(cx - 128, 0)) * greatest(0, least(cy + 128, h) - greatest(cy - 128, 0)) / 65536.0)"""


@query(f"WITH {_AUTO} SELECT image_id, ord, cx, cy FROM auto")
def fixed_grid_auto(s: SparkSession, d: str) -> DataFrame:
    return grids.fixed_grid(dims(s, d), 256, 7).select("image_id", "ord", "cx", "cy")


@query(f"WITH {_STRIDE} SELECT image_id, ord, cx, cy FROM grid WHERE ord < 20")
def fixed_grid_stride(s: SparkSession, d: str) -> DataFrame:
    return grids.fixed_grid(dims(s, d), 256, 20, (120, 90)).select("image_id", "ord", "cx", "cy")


def _crops(s: SparkSession, d: str) -> DataFrame:
    return grids.crop_windows(grids.fixed_grid(dims(s, d), 256, None, (120, 90)), 256)


@query(f"WITH {_STRIDE} SELECT image_id, ord, cx - 128 AS x0, cy - 128 AS y0, cx + 128 AS x1, cy + 128 AS y1, {R(_COVER)} AS coverage FROM grid")
def mask_coverage(s: SparkSession, d: str) -> DataFrame:
    return _crops(s, d).select("image_id", "ord", "x0", "y0", "x1", "y1", "coverage")


@query(f"WITH {_STRIDE} SELECT count(*) AS crops, count(DISTINCT class) AS classes, {R(f'avg({_COVER})')} AS mean, {R(f'min({_COVER})')} AS low, {R(f'max({_COVER})')} AS high FROM grid")
def coverage_summary(s: SparkSession, d: str) -> DataFrame:
    return _crops(s, d).agg(F.count("*").alias("crops"), F.count_distinct("class").alias("classes"), F.avg("coverage").alias("mean"), F.min("coverage").alias("low"), F.max("coverage").alias("high"))


@query(f"""WITH {_STRIDE}, p AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY ord) - 1 AS pos, count(*) OVER (PARTITION BY image_id) AS n FROM grid)
SELECT DISTINCT image_id, ord, cx, cy FROM p JOIN range(9) t(i) ON pos = floor(i * n / 9) OR n <= 9""")
def uniform_subsample(s: SparkSession, d: str) -> DataFrame:
    return grids.uniform_subsample(grids.fixed_grid(dims(s, d), 256, None, (120, 90)), "image_id", ["ord"], 9).select("image_id", "ord", "cx", "cy")


_PATCH = f"{DIMS}, pt AS (SELECT image_id, w, h, i::INT AS i, j::INT AS j, j * 122 AS x0, i * 122 AS y0 FROM dims, range(32) a(i), range(32) b(j) WHERE i * 122 + 224 <= h AND j * 122 + 224 <= w)"


@query(f"WITH {_PATCH} SELECT image_id, i, j FROM pt")
def sliding_patches(s: SparkSession, d: str) -> DataFrame:
    return grids.sliding_patches(dims(s, d)).select("image_id", "i", "j")


@query(f"WITH {_PATCH} SELECT image_id, i, j, x0::INT AS x0, y0::INT AS y0, (x0 + 224)::INT AS x1, (y0 + 224)::INT AS y1 FROM pt")
def patch_windows(s: SparkSession, d: str) -> DataFrame:
    return grids.sliding_patches(dims(s, d)).select("image_id", "i", "j", "x0", "y0", "x1", "y1")


_OVER = f"{_PATCH}, {RECTS}, ov AS (SELECT p.image_id, i, j, greatest(0, least(p.x0 + 224, r.x1) - greatest(p.x0, r.x0)) * greatest(0, least(p.y0 + 224, r.y1) - greatest(p.y0, r.y0)) AS area FROM pt p JOIN rects r ON p.image_id = r.image_id)"


def _patches(s: SparkSession, d: str) -> DataFrame:
    """Patches with their image's rectangle. Images are joined before they are cut, and merged: Spark's sizes count neither the
    rows an explode makes nor what a file's bytes hold once decoded, so that it would broadcast millions of rows."""
    return grids.sliding_patches(dims(s, d).join(rects(s, d).hint("merge"), "image_id"))


@query(f"WITH {_OVER} SELECT image_id, i, j, {R('area')} AS area FROM ov")
def rect_overlap(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    area = lookups.rectangle_overlap([c("x0"), c("y0"), c("x1"), c("y1")], [c("b.minx"), c("b.miny"), c("b.maxx"), c("b.maxy")])
    return _patches(s, d).select("image_id", "i", "j", area.cast("double").alias("area"))


@query(f"WITH {_OVER} SELECT image_id, i, j, {R('area')} AS area FROM ov")
def polygon_clip_area(s: SparkSession, d: str) -> DataFrame:
    return _patches(s, d).select("image_id", "i", "j", geometry.overlap_area(F.col("ring"), *map(F.col, ("x0", "y0", "x1", "y1"))).alias("area"))


@query(f"WITH {_OVER} SELECT image_id, i, j, area / (224 * 224) >= 0.8 AS accepted FROM ov")
def patch_accept_reject(s: SparkSession, d: str) -> DataFrame:
    return lookups.judged_windows(dims(s, d).join(rects(s, d), "image_id"), "ring", grids.PATCH, grids.STEP).select("image_id", "i", "j", "accepted")


# Ten shapes, one after the other: a box, a bow tie, a spike, a corner on a side, a fold into a line, repeated points, a hole, a
# hole that touches in one point, a hole that touches in two, and a hole that reaches out.
@query("""SELECT p_partkey AS image_id, CASE p_partkey % 10 WHEN 0 THEN true WHEN 5 THEN true WHEN 6 THEN true WHEN 7 THEN true ELSE false END AS valid FROM part""")
def ring_validity(s: SparkSession, d: str) -> DataFrame:
    size = F.lit(10.0) + F.col("p_size")
    at = lambda *points: F.array(*[F.array(size * F.lit(float(x)), F.lit(3.0) + size * F.lit(float(y))) for x, y in points])
    box = ((0, 0), (1, 0), (1, 1), (0, 1))
    shells = [box, ((0, 0), (1, 1), (1, 0), (0, 1)), ((0, 0), (1, 0), (1, 1), (1, 2), (1, 1), (0, 1)), ((0, 0), (1, 0), (1, 1), (0.5, 0), (0, 1)), ((0, 0), (1, 0), (0.5, 0)), ((0, 0), (0, 0), (1, 0), (1, 1), (1, 1), (0, 1), (0, 0)), box, box, box, box]
    inner = ((0.25, 0.25), (0.75, 0.25), (0.5, 0.75))
    holes = [*[()] * 6, inner, ((0.5, 0), *inner[1:]), ((0.5, 0), (0.75, 0.5), (0.5, 1)), ((0.5, 0.5), (1.5, 0.5), (0.5, 0.75))]
    kind = (F.col("p_partkey") % 10 + 1).cast("int")
    ring = F.element_at(F.array(*[at(*x) for x in shells]), kind)
    hole = F.element_at(F.array(*[F.array(at(*x)) if x else F.array().cast("array<array<array<double>>>") for x in holes]), kind)
    return table(s, d, "part").select(F.col("p_partkey").alias("image_id"), geometry.valid_polygon(ring, hole).alias("valid"))


@query(f"""WITH {_STRIDE}, {RECTS} SELECT g.image_id, ord FROM grid g JOIN rects r ON g.image_id = r.image_id
WHERE greatest(0, least(cx + 128, r.x1) - greatest(cx - 128, r.x0)) * greatest(0, least(cy + 128, r.y1) - greatest(cy - 128, r.y0)) / 65536.0 > 0.1 - 1e-9""")
def polygon_threshold_crops(s: SparkSession, d: str) -> DataFrame:
    cells = grids.fixed_grid(dims(s, d), 256, None, (120, 90)).join(rects(s, d), "image_id")
    return cells.where(geometry.crop_overlaps(F.col("ring"), F.col("cx"), F.col("cy"), 256, 0.1)).select("image_id", "ord")


@query(f"""WITH {_STRIDE}, {RECTS}, hits AS (SELECT g.*, row_number() OVER (PARTITION BY g.image_id ORDER BY ord) - 1 AS pos, count(*) OVER (PARTITION BY g.image_id) AS n FROM grid g JOIN rects r ON g.image_id = r.image_id
  WHERE g.image_id % 4 <> 0 AND greatest(0, least(cx + 128, r.x1) - greatest(cx - 128, r.x0)) * greatest(0, least(cy + 128, r.y1) - greatest(cy - 128, r.y0)) / 65536.0 > 0.1 - 1e-9),
kept AS (SELECT DISTINCT image_id, class, cx, cy, ord FROM hits JOIN range(5) t(i) ON pos = floor(i * n / 5) OR n <= 5 UNION ALL SELECT image_id, class, cx, cy, ord FROM grid WHERE image_id % 4 = 0 AND ord < 5),
numbered AS (SELECT *, (row_number() OVER (PARTITION BY image_id ORDER BY ord) - 1)::INT AS crop_index FROM kept)
SELECT class || '_' || lpad(image_id::VARCHAR, greatest(4, len(image_id::VARCHAR))::INT, '0') || '_' || lpad(crop_index::VARCHAR, 3, '0') AS crop_id, image_id, crop_index, cx - 128 AS x0, cy - 128 AS y0 FROM numbered""")
def crops_polygon(s: SparkSession, d: str) -> DataFrame:
    """Crops of images with a ring, and of those without one (each fourth): the whole strategy with its numbering."""
    ringed = rects(s, d).where("image_id % 4 <> 0").select("image_id", "ring")
    out = pipelines.crops(dims(s, d).join(ringed, "image_id", "left"), "polygon", n=5, window=256, stride=(120, 90), threshold=0.1, ring="ring", area="class")
    return out.select("crop_id", F.col("source_image_id").alias("image_id"), "crop_index", "x0", "y0")


@query(f"""WITH {DIMS} SELECT image_id, window_::INT AS "window", stride, noise_type, noise_level FROM dims, (VALUES (128), (256)) a(window_), (VALUES ('auto'), ('64'), ('64x32')) b(stride), (VALUES ('gaussian'), ('uniform')) c(noise_type),
(VALUES (0.0::DOUBLE), (0.1), (0.5)) e(noise_level)""")
def config_cross(s: SparkSession, d: str) -> DataFrame:
    return grids.with_configs(dims(s, d).select("image_id"), [128, 256], [None, 64, (64, 32)], ["gaussian", "uniform"], [0, 0.1, 0.5])


@query(f"""WITH {DIMS}, c AS (SELECT 'random' AS strategy, image_id FROM dims, range(3) UNION ALL SELECT 'fixed', image_id FROM dims, range(4)) SELECT strategy, image_id, count(*) AS crops FROM c GROUP BY ALL""")
def batch_union(s: SparkSession, d: str) -> DataFrame:
    runs = grids.random_centres(dims(s, d), "image_id", 3).select(F.lit("random").alias("strategy"), "image_id", "ord")
    runs = runs.unionByName(grids.fixed_grid(dims(s, d), 256, None, 4000).select(F.lit("fixed").alias("strategy"), "image_id", "ord"))
    return runs.groupBy("strategy", "image_id").agg(F.count("*").alias("crops"))


@query(f"""WITH {DIMS}, z AS (SELECT *, greatest(0, floor(w * 0.5) - 100) AS x0, greatest(0, floor(h * 0.5) - 100) AS y0 FROM dims),
e AS (SELECT *, CASE WHEN least(w, x0 + 200) - x0 < 200 THEN greatest(0, least(w, x0 + 200) - 200) ELSE x0 END AS zx, CASE WHEN least(h, y0 + 200) - y0 < 200 THEN greatest(0, least(h, y0 + 200) - 200) ELSE y0 END AS zy FROM z)
SELECT image_id, zx::INT AS zx0, zy::INT AS zy0, (zx + 200)::INT AS zx1, (zy + 200)::INT AS zy1 FROM e""")
def zoom_region(s: SparkSession, d: str) -> DataFrame:
    return grids.zoom_region(dims(s, d)).select("image_id", "zx0", "zy0", "zx1", "zy1")


@query(f"""WITH {_STRIDE}, p AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY ord) - 1 AS pos FROM grid)
SELECT image_id, ord, pos::INT AS pos, (pos % 5 * 256)::INT AS x, (pos // 5 * 256)::INT AS y FROM p WHERE pos < 20""")
def montage_layout(s: SparkSession, d: str) -> DataFrame:
    return grids.montage(grids.fixed_grid(dims(s, d), 256, None, (120, 90)), "image_id", ["ord"], 256).select("image_id", "ord", "pos", "x", "y")


# Geometry ------------------------------------------------------------------------------------------------------------

_GEO = f"{RECTS}, gd AS (SELECT r.*, w, h FROM rects r JOIN d ON r.image_id = d.image_id)".replace("JOIN d ON", "JOIN dims d ON")


def _geo(s: SparkSession, d: str) -> DataFrame:
    return rects(s, d).join(dims(s, d), "image_id").withColumn("p", F.element_at("ring", 1))


def _pixel(s: SparkSession, d: str, mode: str) -> DataFrame:
    at = geometry.point_to_pixel(F.col("b.minx") + 10, F.col("b.miny") + 20, F.col("b"), F.col("w"), F.col("h"), mode)
    return _geo(s, d).select("image_id", at.alias("t")).select("image_id", "t.x", "t.y")


@query(f"WITH {DIMS}, {_GEO} SELECT image_id, {R('10 / (x1 - x0) * w')} AS x, {R('(y1 - y0 - 20) / (y1 - y0) * h')} AS y FROM gd")
def geo_to_pixel_float(s: SparkSession, d: str) -> DataFrame:
    return _pixel(s, d, "float")


@query(f"WITH {DIMS}, {_GEO} SELECT image_id, trunc(10 / (x1 - x0) * w)::INT AS x, trunc((y1 - y0 - 20) / (y1 - y0) * h)::INT AS y FROM gd")
def geo_to_pixel_int(s: SparkSession, d: str) -> DataFrame:
    return _pixel(s, d, "int")


@query(f"WITH {RECTS} SELECT image_id, {R('(x1 - x0) * (y1 - y0)')} AS area FROM rects")
def ring_area(s: SparkSession, d: str) -> DataFrame:
    return rects(s, d).select("image_id", geometry.ring_area(F.col("ring")).alias("area"))


@query(f"WITH {DIMS}, {_GEO} SELECT image_id, {R('(x1 - x0) * (y1 - y0) / (w * h) * 100')} AS percent FROM gd")
def ring_coverage(s: SparkSession, d: str) -> DataFrame:
    return _geo(s, d).select("image_id", geometry.coverage_percent(F.col("ring"), F.col("w"), F.col("h")).alias("percent"))


@query(f"WITH {RECTS} SELECT image_id, x0 AS minx, y0 AS miny, x1 AS maxx, y1 AS maxy FROM rects")
def ring_bounds(s: SparkSession, d: str) -> DataFrame:
    return rects(s, d).select("image_id", geometry.ring_bounds(F.col("ring")).alias("b")).select("image_id", "b.*")


@query(f"WITH {RECTS} SELECT image_id, {R('x0 - 0.05 * (x1 - x0)')} AS minx, {R('y0 - 0.05 * (y1 - y0)')} AS miny, {R('x1 + 0.05 * (x1 - x0)')} AS maxx, {R('y1 + 0.05 * (y1 - y0)')} AS maxy FROM rects")
def padded_bbox(s: SparkSession, d: str) -> DataFrame:
    return rects(s, d).select("image_id", geometry.padded(F.col("b")).alias("b")).select("image_id", "b.*")


_AFFINE = {"a": 0.25, "c": -10.0, "e": -0.25, "f": 500.0}


def _affine() -> Column:
    return F.struct(*[F.lit(v).alias(k) for k, v in _AFFINE.items()])


@query(f"WITH {RECTS} SELECT image_id, floor((y1 - 500) / -0.25)::BIGINT AS row0, floor((x0 + 10) / 0.25)::BIGINT AS col0, floor((y0 - 500) / -0.25)::BIGINT AS row1, floor((x1 + 10) / 0.25)::BIGINT AS col1 FROM rects")
def world_to_pixel(s: SparkSession, d: str) -> DataFrame:
    return rects(s, d).select("image_id", geometry.pixel_window(F.col("b"), _affine()).alias("w")).select("image_id", "w.*")


@query(f"WITH {DIMS} SELECT image_id, {R('0.25 / (w / 100)')} AS a, -10.0::DOUBLE AS c, {R('-0.25 / (h / 100)')} AS e, 500.0::DOUBLE AS f FROM dims")
def affine_rescale(s: SparkSession, d: str) -> DataFrame:
    return dims(s, d).select("image_id", geometry.rescaled(_affine(), F.col("w") / 100, F.col("h") / 100).alias("t")).select("image_id", "t.*")


@query(f"WITH {DIMS} SELECT image_id, 0.25::DOUBLE AS pixel_w, 0.25::DOUBLE AS pixel_h, {R('0.25 * w')} AS geo_w, {R('0.25 * h')} AS geo_h, {R('0.25 * w * 0.25 * h')} AS area FROM dims")
def raster_extent(s: SparkSession, d: str) -> DataFrame:
    return dims(s, d).select("image_id", geometry.raster_extent(_affine(), F.col("w"), F.col("h")).alias("t")).select("image_id", "t.*")


@query(f"WITH {RECTS} SELECT image_id, tx, ty FROM rects, range(16) a(tx), range(16) b(ty) WHERE tx BETWEEN floor(x0 / 100) AND floor(x1 / 100) AND ty BETWEEN floor(y0 / 100) AND floor(y1 / 100)")
def tile_join(s: SparkSession, d: str) -> DataFrame:
    tiles = s.range(16).select(F.col("id").alias("tx")).withColumn("ty", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
    return lookups.tile_join(rects(s, d), tiles, "b", 100.0).select("image_id", "tx", "ty")


# Pixels --------------------------------------------------------------------------------------------------------------


@query(f"WITH {PX} SELECT image_id, r, c, floor((v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0) * 255)::INT AS v FROM px WINDOW w AS (PARTITION BY image_id)")
def minmax_normalize(s: SparkSession, d: str) -> DataFrame:
    return texture.pixels(images(s, d).drop("class").withColumn("v", pixels.minmax_to_uint8(F.col("v"))))


@query(f"WITH {PX}, m AS (SELECT image_id, avg(v) FILTER (r < 6) AS m FROM px GROUP BY 1) SELECT px.image_id, r, c, {R('CASE WHEN r < 6 THEN v ELSE m END')} AS v FROM px JOIN m ON px.image_id = m.image_id")
def noise_fill_level0(s: SparkSession, d: str) -> DataFrame:
    valid = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (i < 48).cast("int"))
    return texture.pixels(images(s, d).drop("class").withColumn("v", pixels.noise_fill(F.col("v"), valid, F.col("image_id"), level=0)))


@query("SELECT p_partkey, ((p_size * 19595 + p_partkey % 256 * 38470 + p_size * 4 * 7471 + 32768) // 65536)::INT AS luma FROM part")
def luma(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select("p_partkey", pixels.luma(F.col("p_size"), F.col("p_partkey") % 256, F.col("p_size") * 4).alias("luma"))


@query("SELECT o_orderkey, greatest(0, least(255, o_custkey - 100))::INT AS v FROM orders")
def clip_uint8(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select("o_orderkey", pixels.clip_uint8(F.col("o_custkey") - 100).alias("v"))


_W = "{n} AS (SELECT j, i, 1 / 8.0::DOUBLE + sum(2 / 8.0::DOUBLE * cos(k * pi() * (2 * j + 1) / (2 * {m})) * cos(k * pi() * (2 * i + 1) / 16)) AS x FROM range({m}) a(j), range(8) b(i), range(1, 8) e(k) GROUP BY 1, 2)"


@query(f"""WITH {PX}, {_W.format(n="wr", m=5)}, {_W.format(n="wc", m=6)} SELECT image_id, wr.j::INT AS r, wc.j::INT AS c, greatest(0, least(255, round_even(sum(wr.x * wc.x * v), 0))) + 0.0 AS v
FROM px JOIN wr ON wr.i = r JOIN wc ON wc.i = c GROUP BY 1, 2, 3""")
def lci_resize(s: SparkSession, d: str) -> DataFrame:
    return _resized(s, d, "chebyshev")


def _resized(s: SparkSession, d: str, kind: str) -> DataFrame:
    small = images(s, d).withColumn("v", pixels.resized(F.col("v"), F.col("h"), F.col("w"), F.lit(5), F.lit(6), kind))
    return texture.pixels(small.select("image_id", "v", F.lit(6).alias("w")))


#: Weights of Keys' kernel with repeated edges, from 8 to m values. (The triangle filter meets exact halves here, which sums in another order round otherwise.)
_K = """{n} AS (SELECT j, i, sum(CASE WHEN d <= 1 THEN 1.5 * d * d * d - 2.5 * d * d + 1 WHEN d < 2 THEN -0.5 * d * d * d + 2.5 * d * d - 4 * d + 2 ELSE 0 END) AS x
FROM (SELECT j, greatest(0, least(7, f + k)) AS i, abs(p - f - k) AS d FROM (SELECT j, p, floor(p) - 1 AS f FROM (SELECT j, (j + 0.5) * 8.0::DOUBLE / {m} - 0.5 AS p FROM range({m}) a(j))), range(4) b(k)) GROUP BY 1, 2)"""


@query()
def bilinear_resize(s: SparkSession, d: str) -> DataFrame:
    return _resized(s, d, "bilinear")


@query(f"""WITH {PX}, {_K.format(n="wr", m=5)}, {_K.format(n="wc", m=6)} SELECT image_id, wr.j::INT AS r, wc.j::INT AS c, greatest(0, least(255, trunc(sum(wr.x * wc.x * v) + 1e-9))) + 0.0 AS v
FROM px JOIN wr ON wr.i = r JOIN wc ON wc.i = c GROUP BY 1, 2, 3""")
def bicubic_resize(s: SparkSession, d: str) -> DataFrame:
    return _resized(s, d, "bicubic")


#: Weights of the cubic B-spline from 8 to m values: blur with mirrored edges, the direct filter's response sqrt(3) z^|k|, the basis.
_S = """{n} AS (SELECT e.j, g.i, sum(e.x * f.x * g.x) AS x
FROM (SELECT j, 7 - abs((fl + k + 14) % 14 - 7) AS b, CASE WHEN abs(p - fl - k) < 1 THEN 2 / 3.0::DOUBLE - pow(p - fl - k, 2) + pow(abs(p - fl - k), 3) / 2 ELSE pow(greatest(0, 2 - abs(p - fl - k)), 3) / 6 END AS x
  FROM (SELECT j, (j + 0.5) * 8.0::DOUBLE / {m} - 0.5 AS p, floor((j + 0.5) * 8.0::DOUBLE / {m} - 0.5)::INT AS fl FROM range({m}) a(j)), range(-1, 3) t(k)) e
JOIN (SELECT b, 7 - abs((b + k + 140) % 14 - 7) AS a, sqrt(3.0::DOUBLE) * pow(sqrt(3.0::DOUBLE) - 2, abs(k)) AS x FROM range(8) u(b), range(-60, 61) t(k)) f ON f.b = e.b
JOIN (SELECT a, 7 - abs((a + k + 14) % 14 - 7) AS i, exp(-0.5 * pow(k / ((8.0::DOUBLE / {m} - 1) / 2), 2)) / (1 + 2 * exp(-0.5 * pow(1 / ((8.0::DOUBLE / {m} - 1) / 2), 2))) AS x FROM range(8) u(a), range(-1, 2) t(k)) g ON g.a = f.a GROUP BY ALL)"""


@query(f"""WITH {PX}, {_S.format(n="wr", m=5)}, {_S.format(n="wc", m=6)}, ends AS (SELECT image_id, min(v) AS low, max(v) AS high FROM px GROUP BY 1),
y AS (SELECT image_id, wr.j::INT AS r, wc.j::INT AS c, sum(wr.x * wc.x * v) AS v FROM px JOIN wr ON wr.i = r JOIN wc ON wc.i = c GROUP BY ALL)
SELECT y.image_id, r, c, trunc(greatest(low, least(high, v)) + 1e-9) + 0.0 AS v FROM y JOIN ends ON y.image_id = ends.image_id""")
def spline_resize(s: SparkSession, d: str) -> DataFrame:
    return _resized(s, d, "spline")


@query()
def noise_gaussian(s: SparkSession, d: str) -> DataFrame:
    valid = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (i < 48).cast("int"))
    return images(s, d).select("image_id", F.posexplode(pixels.noise_fill(F.col("v"), valid, F.col("image_id"), level=0.5)).alias("i", "v"))


@query()
def random_crops(s: SparkSession, d: str) -> DataFrame:
    return grids.crop_windows(grids.random_centres(dims(s, d), "image_id", 5), 256).select("image_id", "ord", "cx", "cy", "coverage")


@query()
def random_subset(s: SparkSession, d: str) -> DataFrame:
    return grids.random_subset(grids.fixed_grid(dims(s, d), 256, None, (120, 90)), "image_id", ["image_id", "ord"], 5).select("image_id", "ord")


@query()
def augment(s: SparkSession, d: str) -> DataFrame:
    three = images(s, d).withColumn("copy", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    return three.select("image_id", "copy", F.posexplode(pixels.augment(F.col("v"), F.col("h"), F.col("w"), F.col("image_id"), F.col("copy"))).alias("i", "v"))


@query()
def geodesic_bbox(s: SparkSession, d: str) -> DataFrame:
    b = F.struct(*[(F.col(f"b.{c}") / 10 - 70).alias(c) for c in ("minx", "miny", "maxx", "maxy")])
    return rects(s, d).select("image_id", geometry.box_metres(b).alias("m")).select("image_id", "m.*")


# Packed colour images and extraction from mosaics ----------------------------------------------------------------------

#: Three bands of each image: its levels, 255 less them, and its levels from the last to the first.
_RGB = """px AS (SELECT vec_id AS image_id, ((i - 1) // 8)::INT AS r, ((i - 1) % 8)::INT AS c, b::INT AS band,
  CASE b WHEN 0 THEN floor((embedding[i]::DOUBLE + 1) * 127.5) WHEN 1 THEN 255 - floor((embedding[i]::DOUBLE + 1) * 127.5) ELSE floor((embedding[65 - i]::DOUBLE + 1) * 127.5) END AS v
  FROM embeddings, range(1, 65) t(i), range(3) u(b))"""


def _colour(s: SparkSession, d: str) -> DataFrame:
    """image_id, data, h, w, bands: 8 x 8 packed pixels of three bands."""
    mixed = F.flatten(F.transform("v", lambda x, i: F.array(x, 255 - x, F.get("v", 63 - i))))
    return images(s, d).select("image_id", packed.from_array(mixed).alias("data"), "h", "w", F.lit(3).alias("bands"))


def _samples(df: DataFrame, w: int) -> DataFrame:
    """image_id, r, c, band, v of packed pixels of three bands."""
    flat = df.select("image_id", F.posexplode(packed.to_array(F.col("data"))).alias("i", "v"))
    at = F.floor(F.col("i") / 3).cast("int")
    return flat.select("image_id", F.floor(at / w).cast("int").alias("r"), (at % w).alias("c"), (F.col("i") % 3).alias("band"), "v")


@query(f"""WITH {_RGB}, {_W.format(n="wr", m=5)}, {_W.format(n="wc", m=6)} SELECT image_id, wr.j::INT AS r, wc.j::INT AS c, band, greatest(0, least(255, round_even(sum(wr.x * wc.x * v), 0)))::INT AS v
FROM px JOIN wr ON wr.i = r JOIN wc ON wc.i = c GROUP BY ALL""")
def lci_resize_rgb(s: SparkSession, d: str) -> DataFrame:
    data = packed.resized(F.col("data"), F.col("h"), F.col("w"), F.col("bands"), F.lit(5), F.lit(6))
    return _samples(_colour(s, d).withColumn("data", data), 6)


@query(f"WITH {_RGB}, m AS (SELECT image_id, band, trunc(avg(v) FILTER (r < 6) + 1e-9) AS m FROM px GROUP BY ALL) SELECT px.image_id, r, c, px.band, (CASE WHEN r < 6 THEN v ELSE m END)::INT AS v FROM px JOIN m ON px.image_id = m.image_id AND px.band = m.band")
def noise_fill_rgb(s: SparkSession, d: str) -> DataFrame:
    mask = F.unhex(F.lit("01" * 48 + "00" * 16))
    data = packed.noise_fill(F.col("data"), F.col("h"), F.col("w"), F.col("bands"), mask, F.col("image_id"), level=0.0)
    return _samples(_colour(s, d).withColumn("data", data), 8)


@query(f"""WITH {_RGB}, mosaic AS (SELECT (image_id // 20 * 8 + r) AS r, (image_id % 20 * 8 + c) AS c, string_agg(v::INT::VARCHAR, ',' ORDER BY band) AS v FROM px GROUP BY ALL),
p AS (SELECT p_partkey AS polygon_index, (1 + p_size % 3)::INT AS class, 100.0 + p_partkey % 60 AS minx, 102.0 + p_partkey % 60 + p_size % 17 AS maxx, 900.0 - p_partkey % 80 AS maxy, 899.0 - p_partkey % 80 - p_size % 10 AS miny FROM part)
SELECT polygon_index, class, 'geoglif_' || lpad(polygon_index::VARCHAR, greatest(4, len(polygon_index::VARCHAR))::INT, '0') || '_ortho.tif' AS ortho_tif, minx::DOUBLE AS minx, miny::DOUBLE AS miny, maxx::DOUBLE AS maxx, maxy::DOUBLE AS maxy,
  ((maxy - miny) * 2)::INT AS height, ((maxx - minx) * 2)::INT AS width, 3 AS channels, md5(string_agg(v, ',' ORDER BY r, c)) AS pixels_md5
FROM p JOIN mosaic ON r >= (900 - maxy) * 2 AND r < (900 - miny) * 2 AND c >= (minx - 100) * 2 AND c < (maxx - 100) * 2 GROUP BY ALL""")
def extraction_record(s: SparkSession, d: str) -> DataFrame:
    """Windows of polygons, cut out of a mosaic whose blocks are the images, and put together."""
    size, x0, y0 = F.col("p_size"), 100 + F.col("p_partkey") % 60, 900 - F.col("p_partkey") % 80
    corner = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    x1, y1 = x0 + 2 + size % 17, y0 - 1 - size % 10
    parts = F.array(F.struct(F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1)).alias("exterior"), F.array().cast("array<array<array<double>>>").alias("interiors")))
    polygons = table(s, d, "part").select(F.col("p_partkey").alias("fid"), (1 + size % 3).alias("class"), parts.alias("polygon_points"), F.lit(32719).alias("srid"), F.lit("mosaic").alias("raster"))
    raster = s.createDataFrame([("mosaic", (0.5, 100.0, -0.5, 900.0), 32719)], "path string, affine struct<a: double, c: double, e: double, f: double>, srid int")
    at = extraction.placed(polygons, raster)
    ty, tx = F.floor(F.col("image_id") / 20), F.col("image_id") % 20
    blocks = _colour(s, d).select(F.lit("mosaic").alias("path"), ty.alias("ty"), tx.alias("tx"), (ty * 8).alias("row0"), (tx * 8).alias("col0"), "h", "w", "bands", F.lit("uint8").alias("dtype"), "data", F.lit(None).cast("string").alias("error"))
    windows = at.select("polygon_index", F.col("raster").alias("path"), "window.*", F.lit(8).alias("block_h"), F.lit(8).alias("block_w"))
    found = geotiff.windows_of_blocks(geotiff.touched(windows), blocks, "polygon_index")
    rows = at.join(found, "polygon_index")
    shown = rows.select(extraction.record(rows).alias("r"), F.md5(F.array_join(packed.to_array(F.col("data")), ",")).alias("pixels_md5"))
    return shown.select("r.polygon_index", "r.class", "r.files.ortho_tif", "r.bounds.*", "r.image_shape.*", "pixels_md5")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean texture per class."""
    return QUERIES["texture_by_class"](spark, sf_dir)
