"""Image -> number metrics over a packed, row-major pixel array, as Spark expressions.

An image is three columns: v array<double> (row by row), h and w int. Every metric is evaluated where the row is: no
explode, no shuffle, no UDF, so a scan of any size stays one stage. `pixels` and `neighbour_pairs` give the same lattice
as rows, for relational work.

Null images give null. An image without the pixels a metric needs (no neighbour pair, no full cell, no mass) gives null,
except where the metric says otherwise; a constant image has no Moran's I (null), entropy 0 and correlation 1.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terragrid.functions import measures
from terragrid.functions.arrays import let, mean, run_lengths, total, upto

POLICIES = ("omit", "propagate")


def _missing(x: Column) -> Column:
    return x.isNull() | F.isnan(x)


def _policy(nan_policy: str, wrap: bool, adjacency: str) -> None:
    if nan_policy not in POLICIES:
        raise ValueError(f"nan_policy must be one of {POLICIES}")
    if adjacency not in ("rook", "queen"):
        raise ValueError("adjacency must be rook or queen")
    if wrap:
        raise ValueError("wrapping lattices are not supported")


def _steps(i: Column, h: Column, w: Column, queen: bool) -> list[tuple[Column, Column]]:
    """(whether it is on the lattice, its index) of each neighbour of pixel i: right, down and diagonals, then the opposite."""
    c = i % w
    left, right, up, down = c > 0, c < w - 1, i >= w, i < (h - 1) * w
    out = [(right, i + 1), (down, i + w), (left, i - 1), (up, i - w)]
    if queen:
        out[2:2] = [(down & left, i + w - 1), (down & right, i + w + 1)]
        out += [(up & left, i - w - 1), (up & right, i - w + 1)]
    return out


def moran(v: Column, h: Column, w: Column, adjacency: str = "rook", nan_policy: str = "omit", wrap: bool = False) -> Column:
    """Moran's I under row-standardised contiguity. `omit`: missing pixels take the mean of the others; `propagate`: NaN."""
    _policy(nan_policy, wrap, adjacency)

    def of(z: Column) -> Column:
        def lag(i: Column) -> Column:
            near = _steps(i, h, w, adjacency == "queen")
            near_sum = sum((F.when(ok, F.get(z, j)).otherwise(0.0) for ok, j in near), F.lit(0.0))
            near_n = sum((ok.cast("int") for ok, _ in near), F.lit(0))
            return F.coalesce(F.get(z, i) * near_sum / F.nullif(near_n, F.lit(0)), F.lit(0.0))

        return total(F.transform(upto(F.size(z)), lag)) / F.nullif(total(F.transform(z, lambda x: x * x)), F.lit(0.0))

    centred = let(mean(F.filter(v, lambda x: ~_missing(x))), lambda m: F.transform(v, lambda x: F.when(_missing(x), 0.0).otherwise(x - m)))
    out = let(centred, of)
    return F.when(F.exists(v, _missing), F.lit(float("nan"))).otherwise(out) if nan_policy == "propagate" else out


def lattice_pairs(v: Column, h: Column, w: Column, adjacency: str = "rook") -> Column:
    """array<struct<a, b>> of the pixels of each unordered neighbour pair, the earlier pixel in a."""

    def at(i: Column) -> Column:
        near = _steps(i, h, w, adjacency == "queen")
        return F.filter(F.array(*[F.when(ok, F.struct(F.get(v, i).alias("a"), F.get(v, j).alias("b"))) for ok, j in near[: len(near) // 2]]), lambda p: p.isNotNull())

    return F.flatten(F.transform(upto(F.size(v)), at))


def spatial_entropy(v: Column, h: Column, w: Column, adjacency: str = "rook", nan_policy: str = "omit", bins: int = 256, wrap: bool = False) -> Column:
    """Entropy in bits of the joint histogram of neighbour pairs, binned over their common range; NaN without pairs."""
    _policy(nan_policy, wrap, adjacency)

    def of(pairs: Column) -> Column:
        ends = F.concat(F.transform(pairs, lambda p: p["a"]), F.transform(pairs, lambda p: p["b"]))
        low, high = F.array_min(ends), F.array_max(ends)

        def binned(r: Column) -> Column:
            to = lambda x: F.least(F.lit(bins - 1), F.floor((x - r["low"]) * bins / (r["high"] - r["low"])))
            counts = run_lengths(F.transform(pairs, lambda p: to(p["a"]) * bins + to(p["b"])))
            return total(F.transform(counts, lambda n: -(n / F.size(pairs)) * F.log2(n / F.size(pairs))))

        some = let(F.struct(low.alias("low"), high.alias("high")), lambda r: F.when(r["low"] == r["high"], F.lit(0.0)).otherwise(binned(r)))
        return F.when(F.size(pairs) == 0, F.lit(float("nan"))).otherwise(some)

    held = F.filter(lattice_pairs(v, h, w, adjacency), lambda p: ~_missing(p["a"]) & ~_missing(p["b"]))
    out = F.when(v.isNotNull(), let(held, of))
    return F.when(F.exists(v, _missing), F.lit(float("nan"))).otherwise(out) if nan_policy == "propagate" else out


def level_pairs(v: Column, w: Column, levels: int = 256) -> Column:
    """array<struct<a, b>> of 8-bit values of each pixel and its right neighbour. Values wrap around, as 8-bit casts do;
    pairs with a missing pixel are left out."""

    def of(g: Column) -> Column:
        inside = F.filter(upto(F.size(g) - 1), lambda i: (i + 1) % w != 0)
        pairs = F.transform(inside, lambda i: F.struct(F.get(g, i).alias("a"), F.get(g, i + 1).alias("b")))
        return F.filter(pairs, lambda p: p["a"].isNotNull() & p["b"].isNotNull())

    return let(F.transform(v, lambda x: F.pmod(x.try_cast("bigint"), F.lit(levels))), of)


def contrast(v: Column, h: Column, w: Column) -> Column:
    """Mean squared difference of horizontal neighbours."""
    return mean(F.transform(level_pairs(v, w), lambda p: ((p["a"] - p["b"]) * (p["a"] - p["b"])).cast("double")))


def homogeneity(v: Column, h: Column, w: Column) -> Column:
    """Mean of 1 / (1 + squared difference) of horizontal neighbours."""
    return mean(F.transform(level_pairs(v, w), lambda p: 1.0 / (1 + (p["a"] - p["b"]) * (p["a"] - p["b"])).cast("double")))


def asm(v: Column, h: Column, w: Column, levels: int = 256) -> Column:
    """Angular second moment: the sum of squared shares of the symmetric co-occurrence matrix."""

    def of(p: Column) -> Column:
        codes = F.concat(F.transform(p, lambda x: x["a"] * levels + x["b"]), F.transform(p, lambda x: x["b"] * levels + x["a"]))
        n = F.nullif(2.0 * F.size(p), F.lit(0.0))
        return F.when(F.size(p) > 0, total(F.transform(run_lengths(codes), lambda c: (c / n) * (c / n))))

    return let(level_pairs(v, w, levels), of)


def energy(v: Column, h: Column, w: Column) -> Column:
    """The root of the angular second moment."""
    return F.sqrt(asm(v, h, w))


def correlation(v: Column, h: Column, w: Column) -> Column:
    """Correlation of the symmetric co-occurrence matrix; 1 where its variance is 0. Sums are exact integers."""

    def of(p: Column) -> Column:
        add = lambda f: F.aggregate(p, F.lit(0).cast("bigint"), lambda a, x: a + f(x))
        n = F.nullif(F.size(p), F.lit(0)).cast("double")
        sums = F.struct(add(lambda x: x["a"] + x["b"]).alias("s"), add(lambda x: x["a"] * x["b"]).alias("ab"), add(lambda x: x["a"] * x["a"] + x["b"] * x["b"]).alias("q"))

        def ratio(t: Column) -> Column:
            mu = t["s"] / (2.0 * n)
            var = t["q"] / (2.0 * n) - mu * mu
            return F.when(var < 1e-15, F.lit(1.0)).otherwise((t["ab"] / n - mu * mu) / F.nullif(var, F.lit(0.0)))

        return F.when(F.size(p) > 0, let(sums, ratio))

    return let(level_pairs(v, w), of)


def hu_log(v: Column, h: Column, w: Column) -> Column:
    """log10(|mu20 + mu02| + 1e-10) of raw central moments; null for an image without mass."""

    def moment(f: Callable[[Column, Column, Column], Column]) -> Column:
        return total(F.transform(v, lambda x, i: f(x, F.floor(i / w), i % w).cast("double")))

    def of(m: Column) -> Column:
        r, c = m["r"] / m["mass"], m["c"] / m["mass"]
        spread = let(F.struct(r.alias("r"), c.alias("c")), lambda k: moment(lambda x, i, j: x * ((i - k["r"]) * (i - k["r"]) + (j - k["c"]) * (j - k["c"]))))
        return F.when(m["mass"] != 0, F.log10(F.abs(spread) + 1e-10))

    return let(F.struct(F.nullif(total(v), F.lit(0.0)).alias("mass"), moment(lambda x, i, j: x * i).alias("r"), moment(lambda x, i, j: x * j).alias("c")), of)


def hog_energy(v: Column, h: Column, w: Column, cell: int = 16, orientations: int = 9) -> Column:
    """Mean square of cell-wise normalised histograms of gradient directions; null without a full cell."""
    eps = 1e-5

    def pixel(i: Column) -> Column:
        r, c = F.floor(i / w), i % w
        gy = F.when((r > 0) & (r < h - 1), F.get(v, i + w) - F.get(v, i - w)).otherwise(0.0)
        gx = F.when((c > 0) & (c < w - 1), F.get(v, i + 1) - F.get(v, i - 1)).otherwise(0.0)
        angle = F.pmod(F.degrees(F.atan2(gy, gx)), F.lit(180.0))
        return F.struct(F.sqrt(gx * gx + gy * gy).alias("m"), F.least(F.lit(orientations - 1), F.floor(angle * orientations / 180)).alias("o"))

    def normalised(x: Column) -> Column:
        return let(F.sqrt(total(F.transform(x, lambda a: a * a)) + eps * eps), lambda n: F.transform(x, lambda a: a / n))

    def block(g: Column, k: Column, across: Column) -> Column:
        top, left = F.floor(k / across) * cell, (k % across) * cell
        inside = F.transform(upto(F.lit(cell * cell)), lambda i: F.get(g, ((top + F.floor(i / cell)) * w + left + i % cell).cast("int")))
        hist = let(inside, lambda p: F.transform(upto(F.lit(orientations)), lambda o: total(F.transform(p, lambda x: F.when(x["o"] == o, x["m"]).otherwise(0.0))) / (cell * cell)))
        clipped = let(normalised(hist), lambda x: F.transform(x, lambda a: F.least(a, F.lit(0.2))))
        return normalised(clipped)

    def of(g: Column) -> Column:
        across, down = F.floor(w / cell).cast("int"), F.floor(h / cell).cast("int")
        return mean(F.transform(F.flatten(F.transform(upto(across * down), lambda k: block(g, k, across))), lambda x: x * x))

    return let(F.transform(upto(F.size(v)), pixel), of)


def lbp_entropy(v: Column, h: Column, w: Column) -> Column:
    """Entropy in nats of uniform local binary patterns (8 points, radius 1; diagonals are interpolated, outside is 0)."""
    a = round(2**-0.5, 5)

    def at(i: Column, dr: int, dc: int) -> Column:
        r, c = F.floor(i / w) + dr, i % w + dc
        return F.when((r >= 0) & (r < h) & (c >= 0) & (c < w), F.get(v, (r * w + c).cast("int"))).otherwise(0.0)

    def point(i: Column, dr: int, dc: int) -> Column:
        if not dr or not dc:
            return at(i, dr, dc)
        side = (1 - a) * a * (at(i, dr, 0) + at(i, 0, dc))
        return (1 - a) * (1 - a) * at(i, 0, 0) + side + a * a * at(i, dr, dc)

    ring = [(0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1)]

    def code(i: Column) -> Column:
        bits = F.array(*[F.when(point(i, dr, dc) - F.get(v, i) >= -1e-9, 1).otherwise(0) for dr, dc in ring])

        def of(b: Column) -> Column:
            ones = F.aggregate(b, F.lit(0), lambda s, x: s + x)
            turns = F.aggregate(F.transform(b, lambda x, j: (x != F.get(b, (j + 1) % 8)).cast("int")), F.lit(0), lambda s, x: s + x)
            return F.when(turns <= 2, ones).otherwise(F.lit(9))

        return let(bits, of)

    n = F.nullif(F.size(v), F.lit(0))
    return F.when(F.size(v) > 0, total(F.transform(run_lengths(F.transform(upto(F.size(v)), code)), lambda c: -(c / n) * F.log(c / n))))


@dataclass(frozen=True)
class MetricSpec:
    """A registered metric: build(v, h, w) gives its column."""

    name: str
    description: str
    unit: str
    build: Callable[[Column, Column, Column], Column]


METRICS: dict[str, MetricSpec] = {
    m.name: m
    for m in (
        MetricSpec("moran", "spatial autocorrelation, row-standardised contiguity", "index", moran),
        MetricSpec("entropy", "entropy of neighbour pairs", "bits", spatial_entropy),
        MetricSpec("contrast", "mean squared difference of neighbours", "levels squared", contrast),
        MetricSpec("homogeneity", "mean closeness of neighbours", "share", homogeneity),
        MetricSpec("energy", "root of summed squared co-occurrence", "share", energy),
        MetricSpec("correlation", "correlation of neighbours", "index", correlation),
        MetricSpec("humoments", "log of the first shape moment", "log10", hu_log),
        MetricSpec("hog", "mean square of gradient histograms", "index", hog_energy),
        MetricSpec("lbp_entropy", "entropy of local binary patterns", "nats", lbp_entropy),
    )
}


def known_metrics(names: list[str]) -> tuple[list[str], list[str]]:
    """(registered names, the others), each in the order given."""
    return [n for n in names if n in METRICS], [n for n in names if n not in METRICS]


def with_metrics(images: DataFrame, names: list[str], v: str = "v", h: str = "h", w: str = "w") -> DataFrame:
    """`images` with one double column for each registered name, all from one look at the pixels (array or packed grey bytes,
    see `measures`); others are left out (see `known_metrics`)."""
    known = known_metrics(names)[0]
    if not known:
        return images
    data = F.col(v) if dict(images.dtypes)[v] == "binary" else F.col(v).cast("array<double>")
    all_of = measures.measured(data, F.col(h).cast("int"), F.col(w).cast("int"), list(dict.fromkeys(known)))
    spare = next(c for c in ("metrics" + "_" * k for k in range(len(images.columns) + 1)) if c not in images.columns)
    rest = [c for c in images.columns if c not in known]
    return images.withColumn(spare, all_of).select(*rest, *[F.col(f"{spare}.{n}").alias(n) for n in dict.fromkeys(known)])


def pixels(images: DataFrame, v: str = "v", w: str = "w") -> DataFrame:
    """One row per pixel: the other columns, r, c and v."""
    keep = [c for c in images.columns if c not in (v, w, "h")]
    rows = images.select(*keep, F.col(w).alias("_w"), F.posexplode(v).alias("_at", "v"))
    return rows.select(*keep, F.floor(F.col("_at") / F.col("_w")).cast("int").alias("r"), (F.col("_at") % F.col("_w")).cast("int").alias("c"), "v")


def neighbour_pairs(px: DataFrame, image_col: str = "image_id") -> DataFrame:
    """image, r, c, a, b, side: each pixel with its right and its lower neighbour, by two windows over one image's pixels."""
    right = F.lead("v").over(W.partitionBy(image_col, "r").orderBy("c"))
    down = F.lead("v").over(W.partitionBy(image_col, "c").orderBy("r"))
    both = px.select(image_col, "r", "c", F.col("v").alias("a"), F.array(F.struct(F.lit("right").alias("side"), right.alias("b")), F.struct(F.lit("down").alias("side"), down.alias("b"))).alias("_n"))
    return both.select(image_col, "r", "c", "a", F.explode("_n").alias("_n")).select(image_col, "r", "c", "a", F.col("_n.b").alias("b"), F.col("_n.side").alias("side")).where("b IS NOT NULL")
