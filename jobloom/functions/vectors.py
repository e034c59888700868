"""Expressions on `array<double>` vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobloom.functions.text import let

# Fixed value: vectors shorter than this are left as they are.
TINY_NORM = 1e-7


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def squared_norm(v: Column) -> Column:
    return F.aggregate(
        v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
    )


def norm(v: Column) -> Column:
    return F.sqrt(squared_norm(v))


def normalized(v: Column) -> Column:
    """Unit vector, or the vector itself when it is (almost) zero."""
    return let(
        norm(v),
        lambda size: F.when(size > TINY_NORM, F.transform(v, lambda x: x / size)).otherwise(v),
    )


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")
