"""Exact order statistics, size summaries, histograms and box plots by group.

Nulls and NaNs are left out of every statistic. Groups may be null (a group of its own) and may hold most of the rows: no
operator gathers a group in one task. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Accuracy of the first look at a group: the bracket of a quantile holds some 8 / ACCURACY of the group's rows.
ACCURACY = 2_000
#: Equal steps that a bracket is cut into.
STEPS = 256
#: Rows that a table of bounds may have to be sent to all executors.
SMALL = 10_000


def _same(left: str, right: str, by: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in by))


def _small(df: DataFrame) -> DataFrame:
    """`df`, worked out at once and marked for broadcasting if it has at most SMALL rows; as it is beyond that."""
    rows = df.take(SMALL + 1)
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= SMALL else df


def exact_quantiles(df: DataFrame, by: Sequence[str], col: str, probs: Sequence[float]) -> DataFrame:
    """by..., n, q array<double>: exact quantiles with linear interpolation.

    A first scan brackets each quantile by approximate ones. A second scan counts what lies below each bracket and the
    distinct values inside (partial sums before the shuffle), by equal steps of the bracket; only the steps that hold a wanted
    rank are ordered. Groups of at most ACCURACY rows lie in one bracket. A bracket that missed its rank is an error.
    """
    by, points = list(by), sorted({float(p) for p in probs})
    keys = [f"k{i}" for i in range(len(by))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.lit(1).alias("every"), F.col(col).cast("double").alias("x"))
    rows, keys = rows.where("x IS NOT NULL AND NOT isnan(x)"), [*keys, "every"]
    near = [min(1.0, max(0.0, p + d / ACCURACY)) for p in points for d in (-3, 3)]
    looks = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"), F.percentile_approx("x", near, ACCURACY).alias("near"))
    few = F.col("n") <= ACCURACY
    low = lambda i: F.when(few | F.lit(near[2 * i] == 0), F.col("least")).otherwise(F.col("near")[2 * i])
    high = lambda i: F.when(few | F.lit(near[2 * i + 1] == 1), F.col("most")).otherwise(F.col("near")[2 * i + 1])
    looks = looks.select(*keys, "n", *[f(i).alias(f"{c}{i}") for i in range(len(points)) for f, c in ((low, "low"), (high, "high"))])

    x, part, inside = F.col("x"), F.lit(len(points) * (STEPS + 2)), F.lit(False)
    for i in reversed(range(len(points))):
        lo, hi, first = F.col(f"low{i}"), F.col(f"high{i}"), i * (STEPS + 2)
        step = F.coalesce(F.floor((x - lo) / F.nullif(hi - lo, F.lit(0.0)) * STEPS), F.lit(0)).cast("int")
        part = F.when(x < lo, F.lit(first)).when(x <= hi, first + 1 + step).otherwise(part)
        inside = inside | x.between(lo, hi)
    placed = rows.alias("a").join(_small(looks).alias("b"), _same("a", "b", keys))
    placed = placed.select(*[F.col(f"a.{k}") for k in keys], "n", part.alias("part"), F.when(inside, x).alias("x"))
    counts = placed.groupBy(*keys, "n", "part", "x").agg(F.count("*").alias("m"))

    before = F.sum("held").over(W.partitionBy(*keys).orderBy("part").rowsBetween(W.unboundedPreceding, -1))  # some STEPS rows a quantile
    sums = counts.groupBy(*keys, "n", "part").agg(F.sum("m").alias("held")).withColumn("before", F.coalesce(before, F.lit(0)))
    place = [F.lit(float(p)) * (F.col("n") - 1) for p in probs]
    ranks = F.array(*[F.struct(F.lit(2 * i + j).alias("i"), f(y).cast("bigint").alias("k")) for i, y in enumerate(place) for j, f in enumerate((F.floor, F.ceil))])
    sums = sums.withColumn("wanted", F.filter(ranks, lambda r: (r["k"] >= F.col("before")) & (r["k"] < F.col("before") + F.col("held")))).where(F.size("wanted") > 0)
    held = counts.alias("a").join(sums.alias("b"), _same("a", "b", [*keys, "part"])).select("a.*", "before", "wanted")
    run = W.partitionBy(*keys, "part").orderBy("x").rowsBetween(W.unboundedPreceding, W.currentRow)
    held = held.withColumn("end", F.col("before") + F.sum("m").over(run))
    hit = F.filter("wanted", lambda r: (r["k"] >= F.col("end") - F.col("m")) & (r["k"] < F.col("end")))
    value = F.coalesce("x", F.raise_error(F.lit("a bracket missed its rank")).cast("double"))
    held = held.select(*keys, "n", "x", F.explode(hit).alias("r")).withColumn("x", value)
    found = held.groupBy(*keys, "n").agg(F.map_from_entries(F.collect_list(F.struct(F.col("r.i").alias("i"), F.col("x").alias("x")))).alias("v"))  # two entries a quantile
    at = lambda i: F.element_at("v", F.lit(i))
    q = [at(2 * i) + (at(2 * i + 1) - at(2 * i)) * (y - F.floor(y)) for i, y in enumerate(place)]
    return found.select(*[F.col(k).alias(c) for k, c in zip(keys, by)], "n", F.array(*q).alias("q"))


def iqr_bounds(df: DataFrame, by: Sequence[str], col: str, factor: float = 1.5) -> DataFrame:
    """by..., low, high: quartiles widened by `factor` interquartile ranges."""
    q = lambda i: F.col("q")[i]
    wide = factor * (q(1) - q(0))
    return exact_quantiles(df, by, col, (0.25, 0.75)).select(*by, (q(0) - wide).alias("low"), (q(1) + wide).alias("high"))


def remove_outliers(df: DataFrame, by: Sequence[str], col: str, factor: float = 1.5) -> DataFrame:
    """The rows whose `col` lies within the bounds of its group, ends included."""
    b = iqr_bounds(df, by, col, factor)
    return df.alias("d").join(_small(b).alias("b"), _same("d", "b", by)).where(F.col(f"d.{col}").between(F.col("low"), F.col("high"))).select("d.*")


def size_statistics(df: DataFrame, by: str, factor: float = 1.5, width: str = "width_m", height: str = "height_m", area: str = "area_m2", px: tuple[str, str] = ("w_px", "h_px")) -> DataFrame:
    """One row per area: count, min and max of all sizes, means without outliers (each column by itself), mean metres a
    pixel, and the window that covers the larger mean side, in metres and pixels (0 without a scale)."""
    keys = ("w", "h", "a")
    held = df.select(F.col(by).alias("g"), *[F.col(c).alias(k) for k, c in zip((*keys, "pw", "ph"), (width, height, area, *px))])
    long = held.select("g", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).cast("double").alias("x")) for k in keys])).alias("s")).select("g", "s.*")
    ends = iqr_bounds(long, ["g", "k"], "x", factor)  # all three columns in one pass
    pick = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{k}_{c}")
    ends = ends.groupBy("g").agg(*[pick(k, c) for k in keys for c in ("low", "high")])
    out = held.alias("d").join(_small(ends).alias("e"), _same("d", "e", ["g"]), "left")
    side = lambda m, p: F.when(F.col(p) > 0, F.col(m) / F.nullif(F.col(p), F.lit(0))).otherwise(0.0)
    scale = (side("w", "pw") + side("h", "ph")) / 2
    aggs = [F.count("*").alias("n"), F.coalesce(F.avg(scale), F.lit(0.0)).alias("m_per_px")]
    for k in keys:
        kept = F.when(F.col(k).between(F.col(f"{k}_low"), F.col(f"{k}_high")), F.col(k))
        aggs += [F.min(k).alias(f"{k}_min"), F.max(k).alias(f"{k}_max"), F.avg(kept).alias(f"{k}_mean"), F.count(kept).alias(f"{k}_kept")]
    metres = F.greatest(F.ceil("w_mean"), F.ceil("h_mean"))
    px_ = F.when(F.col("m_per_px") > 0, F.ceil(metres / F.nullif(F.col("m_per_px"), F.lit(0.0)))).otherwise(0)
    return out.groupBy(F.col("d.g").alias(by)).agg(*aggs).withColumn("window_m", metres).withColumn("window_px", px_)


def histogram(df: DataFrame, by: str, col: str, bins: int = 20) -> DataFrame:
    """by, bin (0-based), n: each group over its own range; the last bin is closed. A constant group lies in the middle."""
    held = df.where(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double"))).select(F.col(by).alias("g"), F.col(col).cast("double").alias("x"))
    ends = held.groupBy("g").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    at = F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("low")) * bins / F.nullif(F.col("high") - F.col("low"), F.lit(0.0))))
    rows = held.alias("a").join(ends.alias("b"), _same("a", "b", ["g"])).select(F.col("a.g").alias(by), F.coalesce(at, F.lit(bins // 2)).cast("int").alias("bin"))
    return rows.groupBy(by, "bin").agg(F.count("*").alias("n"))


def box_plot(df: DataFrame, by: str, col: str, factor: float = 1.5) -> DataFrame:
    """by, n, q1, median, q3, whisker_low, whisker_high (data points within the bounds), fliers (rows beyond)."""
    q = exact_quantiles(df, [by], col, (0.25, 0.5, 0.75)).select(F.col(by).alias("_g"), "n", *[F.col("q")[i].alias(c) for i, c in enumerate(("q1", "median", "q3"))])
    x, wide = F.col(col), factor * (F.col("q3") - F.col("q1"))
    inside = x.between(F.col("q1") - wide, F.col("q3") + wide)
    rows = df.where(x.isNotNull() & ~F.isnan(x.cast("double"))).join(_small(q), F.col(by).eqNullSafe(F.col("_g")))
    return rows.groupBy(by, "n", "q1", "median", "q3").agg(F.min(F.when(inside, x)).alias("whisker_low"), F.max(F.when(inside, x)).alias("whisker_high"), F.count_if(~inside).alias("fliers"))


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """metric, n, mean, std (sample), min, q25, q50, q75, max of each column, quartiles exact."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("x")) for c in cols])).alias("_s")).select("_s.*")
    long = long.where("x IS NOT NULL AND NOT isnan(x)")
    q = exact_quantiles(long, ["metric"], "x", (0.25, 0.5, 0.75)).select("metric", *[F.col("q")[i].alias(f"q{p}") for i, p in enumerate((25, 50, 75))])
    base = long.groupBy("metric").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    return base.join(q, "metric").select("metric", "n", "mean", "std", "min", "q25", "q50", "q75", "max")


def axis_limits(df: DataFrame, cols: Sequence[str], pad: float = 0.05) -> DataFrame:
    """low, high: the range of all values of the columns, widened by `pad` of it at both ends. One row."""
    low, high = (f(*[g(F.col(c).cast("double")) for c in cols]) if len(cols) > 1 else g(F.col(cols[0]).cast("double")) for f, g in ((F.least, F.min), (F.greatest, F.max)))
    return df.agg(low.alias("_l"), high.alias("_h")).select((F.col("_l") - pad * (F.col("_h") - F.col("_l"))).alias("low"), (F.col("_h") + pad * (F.col("_h") - F.col("_l"))).alias("high"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """col, n; order by n descending, then by value, for display."""
    return df.groupBy(col).agg(F.count("*").alias("n"))


def status_counts(df: DataFrame, done: Column) -> DataFrame:
    """processed, skipped: one row."""
    return df.agg(F.count_if(done).alias("processed"), F.count_if(~done).alias("skipped"))


def metric_pairs(df: DataFrame, names: Sequence[str], id_col: str, class_col: str) -> DataFrame:
    """id, x_metric, y_metric, x, y, is_first: the scatter data of each unordered pair of metrics (is_first: class 1)."""
    one = [F.struct(F.lit(a).alias("x_metric"), F.lit(b).alias("y_metric"), F.col(a).alias("x"), F.col(b).alias("y")) for i, a in enumerate(names) for b in names[i + 1 :]]
    return df.select(id_col, (F.col(class_col) == 1).alias("is_first"), F.explode(F.array(*one)).alias("_p")).select(id_col, "is_first", "_p.*")
