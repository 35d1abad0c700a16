"""Small helpers over array columns. Everything is a Spark expression: no UDF, no explode, no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with `value` evaluated once a row, however often (or inside which lambda) the body uses it."""
    return F.transform(F.array(value), body)[0]


def total(values: Column) -> Column:
    """Sum of an array of doubles; 0 for an empty one."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def mean(values: Column) -> Column:
    """Mean of an array of doubles; null for an empty one."""
    return total(values) / F.nullif(F.size(values), F.lit(0))


def upto(n: Column) -> Column:
    """0, 1, ... n - 1; empty for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def run_lengths(values: Column) -> Column:
    """How often each distinct value of an array occurs (array<int>, in the order of the values)."""

    def of(s: Column) -> Column:
        new = lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1))
        return let(F.filter(upto(F.size(s)), new), lambda at: F.transform(at, lambda x, i: F.coalesce(F.get(at, i + 1), F.size(s)) - x))

    return let(F.array_sort(values), of)
