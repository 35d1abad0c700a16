"""Row generators: crop centres, sliding patches, subsamples and montage layouts.

Generators are arrays built by expressions and exploded where the image's row is; nothing is shuffled. Null sizes give no
rows. Images keep their other columns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terragrid.functions.arrays import upto

#: Side, step and least overlap of training patches, by default.
PATCH, STEP, OVERLAP = 224, 122, 0.8


def parse_stride(stride: float | Sequence[float]) -> tuple[float, float]:
    """(x, y) of a number or a pair; both positive."""
    pair = (stride, stride) if isinstance(stride, (int, float)) else tuple(stride)
    if len(pair) != 2:
        raise ValueError("a stride is a number or a pair")
    if min(pair) <= 0:
        raise ValueError("strides are positive")
    return float(pair[0]), float(pair[1])


def free(name: str, *dfs: DataFrame) -> str:
    """`name`, with as many underscores before it as make it no column of `dfs`: for columns that are dropped again."""
    taken = {c.lower() for df in dfs for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def _centres(df: DataFrame, cols: Column, rows: Column, x: Callable[[Column, Column], Column], y: Callable[[Column, Column], Column], n: int | None) -> DataFrame:
    """One row per grid cell in row-major order: ord, gx, gy, cx, cy. x and y make centres of a cell's number along an axis and the number of cells there."""
    across, down = free("_cols", df), free("_rows", df)
    cells = df.withColumn(across, cols.cast("int")).withColumn(down, rows.cast("int"))
    count = F.col(across) * F.col(down)
    cells = cells.withColumn("ord", F.explode(upto(count if n is None else F.least(count, F.lit(max(n, 0))))))
    cells = cells.withColumn("gx", F.col("ord") % F.col(across)).withColumn("gy", F.floor(F.col("ord") / F.col(across)).cast("int"))
    cells = cells.withColumn("cx", F.rint(x(F.col("gx"), F.col(across))).cast("int")).withColumn("cy", F.rint(y(F.col("gy"), F.col(down))).cast("int"))
    return cells.drop(across, down)


def fixed_grid(df: DataFrame, window: int, n: int | None, stride: float | Sequence[float] | None = None, w: str = "w", h: str = "h", whole: bool = False) -> DataFrame:
    """Crop centres on a regular grid, the first n in row-major order (all of them for None with a stride, or if `whole`).

    Without a stride, n or a few more centres are spread over the image. Centres are rounded half to even.
    """
    half, W_, H_ = window // 2, F.col(w), F.col(h)
    if stride is None:
        if n is None:
            raise ValueError("a grid without a stride needs n")
        if n <= 0:
            nowhere = lambda g, k: F.lit(0.0)
            return _centres(df, F.lit(0), F.lit(0), nowhere, nowhere, 0)
        cols = F.greatest(F.lit(1), F.ceil(F.sqrt(F.lit(n) * F.coalesce(W_ / F.nullif(H_, F.lit(0)), F.lit(1.0)))))
        rows = F.greatest(F.lit(1), F.ceil(F.lit(n) / cols))
        at = lambda size: lambda g, k: half + g * (F.greatest(F.lit(half), size - half) - half) / F.greatest(F.lit(1), k - 1)
        return _centres(df, cols, rows, at(W_), at(H_), None if whole else n)
    sx, sy = parse_stride(stride)
    count = lambda size, s: F.ceil((F.greatest(size, F.lit(half)) + s - half) / s)
    return _centres(df, count(W_, sx), count(H_, sy), lambda g, k: half + g * sx, lambda g, k: half + g * sy, None if whole else n)


def random_centres(df: DataFrame, key: str, n: int, seed: int = 0, w: str = "w", h: str = "h") -> DataFrame:
    """n centres an image, uniform over its pixels and fixed by the key, the number and the seed."""
    draw = lambda size, axis: F.pmod(F.xxhash64(F.col(key), F.col("ord"), F.lit(seed), F.lit(axis)), F.col(size).cast("bigint")).cast("int")
    return df.where((F.col(w) > 0) & (F.col(h) > 0)).withColumn("ord", F.explode(upto(F.lit(n)))).withColumn("cx", draw(w, 0)).withColumn("cy", draw(h, 1))


def crop_windows(df: DataFrame, window: int, w: str = "w", h: str = "h") -> DataFrame:
    """Adds x0, y0, x1, y1 (the window around cx, cy) and coverage (the share of it on the image; 0 if it is off it)."""
    half = window // 2
    out = df.withColumn("x0", F.col("cx") - half).withColumn("y0", F.col("cy") - half).withColumn("x1", F.col("x0") + window).withColumn("y1", F.col("y0") + window)
    side = lambda a, b, size: F.greatest(F.lit(0), F.least(F.col(b), F.col(size)) - F.greatest(F.col(a), F.lit(0)))
    return out.withColumn("coverage", side("x0", "x1", w) * side("y0", "y1", h) / float(window * window))


def sliding_patches(df: DataFrame, size: int = PATCH, step: int = STEP, w: str = "w", h: str = "h") -> DataFrame:
    """i, j and the window x0, y0, x1, y1 of each full patch; images smaller than a patch have none."""
    count = lambda c: F.when(F.col(c) >= size, F.floor((F.col(c) - size) / step) + 1).otherwise(0).cast("int")
    rows = df.withColumn("i", F.explode(upto(count(h)))).withColumn("j", F.explode(upto(count(w))))
    return rows.withColumn("x0", F.col("j") * step).withColumn("y0", F.col("i") * step).withColumn("x1", F.col("x0") + size).withColumn("y1", F.col("y0") + size)


def uniform_subsample(df: DataFrame, key: str, order: Sequence[str], n: int) -> DataFrame:
    """At most n rows a key, at the positions floor(i * N / n) of the given order; all where N <= n.

    The window runs over one image's crops. `order` has to be total.
    """
    of = W.partitionBy(key)
    place, size = free("_p", df), free("_n", df)
    at = df.withColumn(place, F.row_number().over(of.orderBy(*order)) - 1).withColumn(size, F.count("*").over(of))
    p, count = F.col(place), F.col(size)
    i = F.ceil(p * n / count)  # the one number whose position may be p
    return at.where((count <= n) | ((i < n) & (F.floor(i * count / n) == p))).drop(place, size)


def random_subset(df: DataFrame, key: str, ids: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """n rows a key without replacement, drawn by a seeded hash of `ids` (ties by `ids`)."""
    draw = W.partitionBy(key).orderBy(F.xxhash64(*[F.col(c) for c in ids], F.lit(seed)), *ids)
    place = free("_p", df)
    return df.withColumn(place, F.row_number().over(draw)).where(F.col(place) <= n).drop(place)


def montage(df: DataFrame, key: str, order: Sequence[str], side: int, across: int = 5, cap: int = 20) -> DataFrame:
    """pos, x, y of the first `cap` crops a key on a sheet, `across` a row."""
    pos = F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1
    out = df.withColumn("pos", pos).where(F.col("pos") < cap)
    return out.withColumn("x", F.col("pos") % across * side).withColumn("y", F.floor(F.col("pos") / across).cast("int") * side)


def zoom_region(df: DataFrame, size: int = 200, ratio: float = 0.5, w: str = "w", h: str = "h") -> DataFrame:
    """zx0, zy0, zx1, zy1: a square of fixed size around the image's middle, moved back inside at the edges."""

    def start(c: str) -> Column:
        low = F.greatest(F.lit(0), F.floor(F.col(c) * ratio).cast("int") - size // 2)
        end = F.least(F.col(c), low + size)
        return F.when(end - low < size, F.greatest(F.lit(0), end - size)).otherwise(low)

    out = df.withColumn("zx0", start(w)).withColumn("zy0", start(h))
    return out.withColumn("zx1", F.col("zx0") + size).withColumn("zy1", F.col("zy0") + size)


def zoom_on_scaled(df: DataFrame, scaled_w: str, scaled_h: str, w: str = "w", h: str = "h") -> DataFrame:
    """The zoom region's corners on the resized image, truncated."""
    out = df
    for c, a, b in (("zx0", scaled_w, w), ("zx1", scaled_w, w), ("zy0", scaled_h, h), ("zy1", scaled_h, h)):
        out = out.withColumn(f"s{c}", F.floor(F.col(c) * (F.col(a) / F.nullif(F.col(b), F.lit(0)))).cast("int"))
    return out


def with_configs(df: DataFrame, windows: Sequence[int], strides: Sequence[object], noises: Sequence[str], levels: Sequence[float]) -> DataFrame:
    """`df` with window, stride (a label), noise_type, noise_level: each row once for every combination of a few options."""
    axes = {"window": F.array(*map(F.lit, windows)), "stride": F.array(*[F.lit(stride_label(s)) for s in strides]), "noise_type": F.array(*map(F.lit, noises)), "noise_level": F.array(*[F.lit(float(x)) for x in levels])}
    for name, values in axes.items():
        df = df.withColumn(name, F.explode(values))
    return df


def config_grid(spark, windows: Sequence[int], strides: Sequence[object], noises: Sequence[str], levels: Sequence[float]) -> DataFrame:
    """window, stride (a label), noise_type, noise_level: every combination of a few options, made of literals."""
    return with_configs(spark.range(1), windows, strides, noises, levels).drop("id")


def stride_label(stride: float | Sequence[float] | None) -> str:
    """`auto`, `64` or `64x32`."""
    if stride is None:
        return "auto"
    short = lambda x: str(int(x)) if float(x).is_integer() else str(x)
    return short(stride) if isinstance(stride, (int, float)) else "x".join(map(short, stride))


#: Crop strategies by name: what they do and their parameters with defaults.
STRATEGIES = {
    "random": ("uniform centres, seeded", {"n": 10, "window": 256, "seed": 0}),
    "fixed": ("regular grid", {"n": 10, "window": 256, "stride": None}),
    "polygon": ("regular grid where the window overlaps the polygon", {"n": 10, "window": 256, "stride": None, "threshold": 0.1}),
}
