"""Expressions over vectors: structs of two numbers, x and y, and arrays of any number of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vec(x: Column | str, y: Column | str) -> Column:
    """Columns seen as one vector."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.struct(as_col(x).alias("x"), as_col(y).alias("y"))


def zero() -> Column:
    return vec(F.lit(0.0), F.lit(0.0))


def cardinal(axis: str) -> Column:
    return vec(F.lit(float(axis == "x")), F.lit(float(axis == "y")))


def random(seed: int) -> Column:
    return vec(F.rand(seed), F.rand(seed + 1))


def _each(f, *vs: Column) -> Column:
    return vec(f(*(v["x"] for v in vs)), f(*(v["y"] for v in vs)))


def add(a: Column, b: Column) -> Column:
    return _each(lambda p, q: p + q, a, b)


def subtract(a: Column, b: Column) -> Column:
    return _each(lambda p, q: p - q, a, b)


def scale(a: Column, k: Column | float) -> Column:
    return _each(lambda p: p * k, a)


def divide(a: Column, k: Column | float) -> Column:
    """Null components where k is zero."""
    return _each(lambda p: F.try_divide(p, F.lit(k) if not isinstance(k, Column) else k), a)


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"]


def length_squared(a: Column) -> Column:
    return dot(a, a)


def length(a: Column) -> Column:
    return F.sqrt(length_squared(a))


def normalize(a: Column) -> Column:
    """Null components for the zero vector."""
    return divide(a, length(a))


def least(a: Column, b: Column) -> Column:
    return _each(F.least, a, b)


def greatest(a: Column, b: Column) -> Column:
    return _each(F.greatest, a, b)


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.greatest(as_col(low), F.least(x, as_col(high)))


# -- arrays of k numbers


def vec_k(*parts: Column | str) -> Column:
    """k columns seen as one vector."""
    return F.array(*parts)


def subvector(a: Column, without: int) -> Column:
    """The vector of one dimension less: without the component at place `without`, from 0."""
    return F.concat(F.slice(a, 1, without), F.slice(a, without + 2, F.greatest(F.size(a) - without - 1, F.lit(0))))


def zero_k(k: int) -> Column:
    return F.array_repeat(F.lit(0.0), k)


def cardinal_k(k: int, place: int) -> Column:
    return F.array(*(F.lit(float(i == place)) for i in range(k)))


def add_k(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract_k(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale_k(a: Column, k: Column | float) -> Column:
    return F.transform(a, lambda x: x * k)


def dot_k(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def length_k(a: Column) -> Column:
    return F.sqrt(dot_k(a, a))
