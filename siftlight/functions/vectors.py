"""Column functions on arrays of numbers, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_double(v), F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    size = norm(v)
    return F.transform(_double(v), lambda x: F.when(size > 0, x / size).otherwise(x))


def literal(v) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def preview(v: Column, n: int = 8) -> Column:
    """The first numbers and the length, for display."""
    shown = F.array_join(F.transform(F.slice(_double(v), 1, n), lambda x: F.format_string("%+.4f", x)), ", ")
    return F.format_string("[%s, ...] (norm %.4f)", shown, norm(v))
