"""Dense vector expressions on array columns, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def let(value: Column, body) -> Column:
    """body(value) with the value computed once per row.

    An expression named inside a lambda is evaluated for every element; binding it to a lambda variable of
    a one-element array avoids that.
    """
    return F.transform(F.array(value), body)[0]


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    return let(norm(v) + F.lit(EPS), lambda n: F.transform(as_double(v), lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + F.lit(EPS))


def squared_l2(a: Column, b: Column) -> Column:
    parts = F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)


def total(v: Column) -> Column:
    return F.aggregate(as_double(v), F.lit(0.0), lambda acc, x: acc + x)
