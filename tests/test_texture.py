"""Closed forms and numpy versions of the metrics, with the edges of their domain."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terragrid.functions import measures, texture


def cols():
    return F.col("v"), F.col("h"), F.col("w")


IMAGES = {
    "board": np.indices((4, 4)).sum(axis=0) % 2 * 9.0,
    "flat": np.full((3, 3), 7.0),
    "gradient": np.arange(20.0).reshape(4, 5),
    "pixel": np.array([[5.0]]),
    "row": np.array([[1.0, 4.0, 2.0]]),
    "column": np.array([[1.0], [4.0], [2.0]]),
    "hole": np.array([[1.0, np.nan, 3.0], [4.0, 5.0, 6.0]]),
    "lost": np.full((2, 2), np.nan),
    "random": np.random.default_rng(3).integers(0, 256, (32, 24)).astype(float),
}


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(k, x.ravel().tolist(), *x.shape) for k, x in IMAGES.items()] + [("null", None, 2, 2)]
    return spark.createDataFrame(rows, "name string, v array<double>, h int, w int").cache()


def values(frame, build):
    return {r.name: r.x for r in frame.select("name", build(*cols()).alias("x")).collect()}


def neighbours(x):
    h, w = x.shape
    for r in range(h):
        for c in range(w):
            yield (r, c), [(r + a, c + b) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)) if 0 <= r + a < h and 0 <= c + b < w]


def numpy_moran(x):
    z = np.where(np.isnan(x), np.nanmean(x) if not np.isnan(x).all() else 0, x)
    z = z - z.mean()
    num = sum(z[p] * np.mean([z[q] for q in near]) for p, near in neighbours(z) if near)
    return num / (z**2).sum() if (z**2).sum() else None


def test_moran(frame):
    got = values(frame, texture.moran)
    assert got["board"] == pytest.approx(-1) and got["flat"] is None and got["pixel"] is None and got["lost"] is None and got["null"] is None
    for k in ("gradient", "row", "column", "hole", "random"):
        assert got[k] == pytest.approx(numpy_moran(IMAGES[k])), k
    assert math.isnan(values(frame, lambda v, h, w: texture.moran(v, h, w, nan_policy="propagate"))["hole"])
    with pytest.raises(ValueError):
        texture.moran(*cols(), nan_policy="drop")
    with pytest.raises(ValueError):
        texture.moran(*cols(), wrap=True)


def test_entropy(frame):
    got = values(frame, texture.spatial_entropy)
    assert got["flat"] == 0 and math.isnan(got["pixel"]) and math.isnan(got["lost"]) and got["null"] is None
    x = IMAGES["random"]
    a = np.concatenate([x[:, :-1].ravel(), x[:-1].ravel()])
    b = np.concatenate([x[:, 1:].ravel(), x[1:].ravel()])
    low, high = min(a.min(), b.min()), max(a.max(), b.max())
    p = np.histogram2d(a, b, bins=256, range=[[low, high]] * 2)[0] / len(a)
    assert got["random"] == pytest.approx(-(p[p > 0] * np.log2(p[p > 0])).sum())


def test_pairs_of_levels(frame):
    x = IMAGES["random"].astype(int)
    a, b = x[:, :-1].ravel(), x[:, 1:].ravel()
    s, t = np.concatenate([a, b]), np.concatenate([b, a])
    share = np.unique(s * 256 + t, return_counts=True)[1] / len(s)
    want = {"contrast": ((a - b) ** 2).mean(), "homogeneity": (1 / (1 + (a - b) ** 2)).mean(), "energy": math.sqrt((share**2).sum()), "correlation": np.corrcoef(s, t)[0, 1]}
    for name, x in want.items():
        got = values(frame, texture.METRICS[name].build)
        assert got["random"] == pytest.approx(x), name
        assert got["pixel"] is None and got["column"] is None and got["null"] is None
    assert values(frame, texture.correlation)["flat"] == 1


def test_shape_moment(frame):
    x = IMAGES["random"]
    r, c = np.indices(x.shape)
    rm, cm = (x * r).sum() / x.sum(), (x * c).sum() / x.sum()
    assert values(frame, texture.hu_log)["random"] == pytest.approx(math.log10((x * ((r - rm) ** 2 + (c - cm) ** 2)).sum() + 1e-10))


def numpy_hog(x, cell=16):
    gy, gx = np.zeros_like(x), np.zeros_like(x)
    gy[1:-1], gx[:, 1:-1] = x[2:] - x[:-2], x[:, 2:] - x[:, :-2]
    size, angle = np.hypot(gx, gy), np.degrees(np.arctan2(gy, gx)) % 180
    out = []
    for r in range(x.shape[0] // cell):
        for c in range(x.shape[1] // cell):
            at = np.s_[r * cell : (r + 1) * cell, c * cell : (c + 1) * cell]
            hist = np.array([size[at][(angle[at] >= 20 * o) & (angle[at] < 20 * o + 20)].sum() for o in range(9)]) / cell**2
            hist = np.minimum(hist / math.sqrt((hist**2).sum() + 1e-10), 0.2)
            out.append(hist / math.sqrt((hist**2).sum() + 1e-10))
    return np.mean(np.square(out))


def test_gradient_histograms(frame):
    got = values(frame, texture.hog_energy)
    assert got["random"] == pytest.approx(numpy_hog(IMAGES["random"])) and got["board"] is None and got["null"] is None


def numpy_lbp(x):
    h, w = x.shape
    a = round(math.sqrt(0.5), 5)
    pad = np.pad(x, 1)
    centre = pad[1:-1, 1:-1]

    def at(dr, dc):
        return pad[1 + dr : 1 + dr + h, 1 + dc : 1 + dc + w]

    ring = [(0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1)]
    point = [at(r, c) if not r or not c else (1 - a) ** 2 * centre + (1 - a) * a * (at(r, 0) + at(0, c)) + a * a * at(r, c) for r, c in ring]
    bits = np.stack([(p - centre >= -1e-9).astype(int) for p in point])
    turns = (bits != np.roll(bits, -1, axis=0)).sum(axis=0)
    p = np.unique(np.where(turns <= 2, bits.sum(axis=0), 9), return_counts=True)[1] / (h * w)
    return -(p * np.log(p)).sum()


def test_local_patterns(frame):
    got = values(frame, texture.lbp_entropy)
    for k in ("random", "board", "gradient", "row", "pixel"):
        assert got[k] == pytest.approx(numpy_lbp(IMAGES[k])), k


def test_registry(frame):
    assert texture.known_metrics(["hog", "blur", "moran"]) == (["hog", "moran"], ["blur"])
    assert texture.with_metrics(frame, ["contrast", "blur"]).columns == ["name", "v", "h", "w", "contrast"]


def same(a, b):
    return a is b or (a is not None and b is not None and (a == pytest.approx(b, abs=1e-9) or math.isnan(a) and math.isnan(b)))


def test_batch_equals_expressions(spark, frame, monkeypatch):
    """Every metric of the batch is that of its expression, image by image, whatever the slices; missing pixels as documented."""
    rng = np.random.default_rng(8)
    more = [(f"r{k}", rng.integers(0, rng.integers(2, 400), (h, w)).astype(float).ravel().tolist(), h, w) for k, (h, w) in enumerate(rng.integers(1, 40, (40, 2)).tolist())]
    df = frame.unionByName(spark.createDataFrame([*more, ("empty", [], 0, 0), ("misfit", [1.0, 2.0], 2, 2), ("no size", [1.0], None, 1)], frame.schema)).repartition(3)
    names = list(texture.METRICS)
    for pixels in (measures.PIXELS, 50):
        monkeypatch.setattr(measures, "PIXELS", pixels)
        got = {r.name: r.m for r in df.select("name", measures.measured(*cols(), names, cell=8).alias("m")).collect()}
        want = {r.name: r for r in df.where("name NOT IN ('misfit', 'no size')").select("name", *[(texture.hog_energy(*cols(), cell=8) if n == "hog" else texture.METRICS[n].build(*cols())).alias(n) for n in names]).collect()}
        for k, row in want.items():
            for n in names:
                if k in ("hole", "lost") and n in ("hog", "lbp_entropy", "humoments"):
                    assert got[k][n] is None
                else:
                    assert same(got[k][n], row[n]), (k, n, got[k][n], row[n])
        assert set(got["misfit"]) == set(got["no size"]) == {None}


def test_batch_of_packed_images(spark):
    x = np.random.default_rng(2).integers(0, 256, (3, 20, 30))
    df = spark.createDataFrame([(k, bytearray(p.astype(np.uint8).tobytes()), p.astype(float).ravel().tolist(), 20, 30, 1.5) for k, p in enumerate(x)] + [(3, None, None, 20, 30, 1.5)], "k int, data binary, v array<double>, h int, w int, metrics double")
    names = list(texture.METRICS)
    packed = texture.with_metrics(df, names, v="data").drop("data", "v")
    assert packed.columns == ["k", "h", "w", "metrics", *names]
    assert sorted(packed.collect()) == sorted(texture.with_metrics(df, names).drop("data", "v").collect())
    with pytest.raises(ValueError):
        measures.measured(*cols(), ["blur"])
