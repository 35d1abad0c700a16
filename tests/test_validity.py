"""Validity against fixed answers and against all pairs of sides in fractions; overlaps against clipping."""

from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terragrid.functions import geometry, validity
from terragrid.operators import lookups

BOX = [(0, 0), (9, 0), (9, 9), (0, 9)]
CASES = {
    "box": ([BOX], True),
    "closed": ([[*BOX, BOX[0]]], True),
    "repeated": ([[BOX[0], *BOX]], True),
    "bow tie": ([[(0, 0), (2, 2), (2, 0), (0, 2)]], False),
    "corner on a side": ([[(0, 0), (4, 0), (4, 4), (2, 0), (0, 4)]], False),
    "corner on a corner": ([[(0, 0), (2, 2), (4, 0), (4, 4), (2, 2), (0, 4)]], False),
    "spike": ([[(0, 0), (4, 0), (6, 0), (4, 0), (4, 4)]], False),
    "sides on one another": ([[(0, 0), (4, 0), (4, 4), (3, 4), (3, 0), (2, 0), (2, 4), (0, 4)]], False),
    "line": ([[(0, 0), (4, 4), (2, 2)]], False),
    "two points": ([[(0, 0), (4, 4), (0, 0)]], False),
    "one point": ([[(1, 1)] * 4], False),
    "not a number": ([[(0, 0), (float("nan"), 1), (1, 1)]], False),
    "hole": ([BOX, [(2, 2), (3, 2), (2, 3)]], True),
    "hole outside": ([BOX, [(12, 2), (13, 2), (12, 3)]], False),
    "hole around": ([[(2, 2), (3, 2), (2, 3)], BOX], False),
    "hole across": ([BOX, [(5, 5), (15, 5), (5, 6)]], False),
    "hole touches": ([BOX, [(0, 5), (3, 4), (3, 6)]], True),
    "hole touches twice": ([BOX, [(0, 5), (9, 5), (4, 6)]], False),
    "hole along a side": ([BOX, [(0, 3), (0, 6), (4, 5)]], False),
    "hole in a hole": ([BOX, [(1, 1), (8, 1), (8, 8), (1, 8)], [(3, 3), (4, 3), (3, 4)]], False),
    "equal holes": ([BOX, [(3, 3), (4, 3), (3, 4)], [(3, 3), (4, 3), (3, 4)]], False),
    "holes touch": ([BOX, [(1, 1), (4, 4), (1, 4)], [(4, 4), (7, 7), (7, 4)]], True),
    "holes in a chain from side to side": ([BOX, [(0, 4), (4, 4), (2, 5)], [(4, 4), (9, 4), (6, 5)]], False),
}


@pytest.mark.parametrize("name", CASES)
def test_fixed_polygons(name):
    rings, answer = CASES[name]
    assert validity.is_valid([np.array(r, float) for r in rings]) is answer
    turned = [np.array(r[::-1], float) for r in rings]
    assert validity.is_valid(turned) is answer


def brute(ring):
    """Sides as fractions, all pairs: apart, or neighbours that share one point and no more."""
    ring = [p for k, p in enumerate(ring) if p != ring[k - 1]]
    n = len(ring)
    if n < 3:
        return False
    f = [(Fraction(x), Fraction(y)) for x, y in ring]
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    on = lambda a, b, p: turn(a, b, p) == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])
    for i in range(n):
        for j in range(i + 1, n):
            a, b, c, d = f[i], f[(i + 1) % n], f[j], f[(j + 1) % n]
            near = {(i + 1) % n == j, (j + 1) % n == i}
            if near == {False}:
                if (turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0) or on(a, b, c) or on(a, b, d) or on(c, d, a) or on(c, d, b):
                    return False
            else:
                p, q = (a, d) if (i + 1) % n == j else (b, c)
                if on(a, b, q) or on(c, d, p):
                    return False
    return True


POINT = st.tuples(*[st.integers(0, 6).map(lambda v: v / 10)] * 2)  # tenths: many points in a line, none exact in doubles


@settings(max_examples=400, deadline=None)
@given(st.lists(POINT, min_size=1, max_size=9))
def test_rings_against_all_pairs(ring):
    assert validity.is_valid([np.array(ring, float)]) == brute(ring)


def test_many_sides_are_judged_in_batches(monkeypatch):
    angle = np.linspace(0, 2 * np.pi, 5_000, endpoint=False)
    star = np.stack([np.cos(angle), np.sin(angle)], axis=1) * np.where(np.arange(5_000) % 2, 1.0, 0.9)[:, None]
    for pairs in (validity.PAIRS, 1_000):
        monkeypatch.setattr(validity, "PAIRS", pairs)
        assert validity.is_valid([star])
        crossed = star.copy()
        crossed[[100, 103]] = crossed[[103, 100]]
        assert not validity.is_valid([crossed])


def test_column_with_holes_and_nulls(spark):
    rows = [(k, [list(map(float, p)) for p in r[0]], [[list(map(float, p)) for p in h] for h in r[1:]], ok) for k, (r, ok) in CASES.items()]
    rows += [("none", None, None, None), ("no holes", rows[0][1], None, True), ("a null hole", rows[0][1], [None], True), ("empty", [], [], False), ("half a point", [[0.0], [1.0, 1.0], [2.0, 0.0]], [], False)]
    df = spark.createDataFrame(rows, "k string, ring array<array<double>>, holes array<array<array<double>>>, answer boolean")
    got = df.select("k", "answer", geometry.valid_polygon(F.col("ring"), F.col("holes")).alias("ok")).collect()
    assert len(got) == len(rows) and all(r.ok is r.answer for r in got), [r.k for r in got if r.ok is not r.answer]


def test_overlap_areas_equal_clipped_ones(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(300):
        angle = np.sort(rng.random(rng.integers(3, 12))) * 2 * np.pi
        ring = np.stack([np.cos(angle), np.sin(angle)], axis=1) * rng.integers(1, 30, (len(angle), 1)) + 20
        ring = np.rint(ring) if k % 2 else ring
        x, y = rng.integers(0, 30, 2).tolist()
        rows.append((k, ring.tolist(), x, y, x + int(rng.integers(0, 25)), y + int(rng.integers(1, 25))))
    df = spark.createDataFrame(rows, "k int, ring array<array<double>>, x0 int, y0 int, x1 int, y1 int")
    box = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    clipped = geometry.ring_area(geometry.clip_to_box(F.col("ring"), *box))
    got = df.select("k", geometry.overlap_area(F.col("ring"), *box).alias("a"), clipped.alias("b")).collect()
    assert [r.a for r in got] == pytest.approx([r.b for r in got], abs=1e-9) and sum(r.a > 0 for r in got) > 150


def test_judged_windows(spark):
    ring = [[100.0, 0.0], [500.0, 0.0], [500.0, 400.0], [100.0, 400.0]]
    bow = [[0.0, 0.0], [600.0, 600.0], [600.0, 0.0], [0.0, 600.0]]
    df = spark.createDataFrame([(1, ring, 600, 600, 7), (2, bow, 600, 600, 7), (3, None, 600, 600, 7), (4, ring, 100, 100, 7), (5, [[0.0, 0.0], [9.0, 0.0], [9.0, 9.0]], 600, 600, 7)], "image_id int, ring array<array<double>>, w int, h int, valid int")
    got = lookups.judged_windows(df, "ring", 224, 122)
    assert got.columns == [*df.columns, "i", "j", "x0", "y0", "x1", "y1", "accepted"]
    rows = got.collect()
    assert {r.valid for r in rows} == {7} and {r.image_id for r in rows} == {1, 2, 3, 5}
    for r in rows:
        inside = max(0, min(r.x1, 500) - max(r.x0, 100)) * max(0, min(r.y1, 400) - r.y0) / 224**2 >= 0.8
        assert r.accepted == {1: inside, 2: False, 3: True, 5: False}[r.image_id]
