"""Vector expressions over arrays, in double precision and without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 when one has no length, an error when the widths differ."""
    value = F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors must have the same width")).cast("double")) \
        .otherwise(value)


def vector_from_text(c: Column) -> Column:
    """``[a,b]`` or ``(a,b)`` to an array of floats."""
    parts = F.split(F.regexp_replace(c, r"[\[\]()]", ""), ",")
    return F.transform(parts, lambda x: F.trim(x).try_cast("float"))


def vector_to_text(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(v.cast("array<string>"), ","), F.lit("]"))
