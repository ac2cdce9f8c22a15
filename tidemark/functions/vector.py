"""Vector expressions (N1, N2): all JVM-side, on arrays cast to double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    """A vector as array<double>; arithmetic on floats would differ in the eighth digit."""
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column, mismatch: str = "error") -> Column:
    """N1. Cosine similarity; 0 where a vector has no length. mismatch says what unlike lengths give
    (Q11): an error, zero, or infinity."""
    a, b = doubles(a), doubles(b)
    size = norm(a) * norm(b)
    value = F.when(size == 0, 0.0).otherwise(dot(a, b) / size)
    return _guarded(a, b, value, mismatch)


def euclidean(a: Column, b: Column, mismatch: str = "infinity") -> Column:
    """N2. Euclidean distance."""
    a, b = doubles(a), doubles(b)
    return _guarded(a, b, F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)), mismatch)


def _guarded(a: Column, b: Column, value: Column, mismatch: str) -> Column:
    other = {"error": F.raise_error(F.lit("vectors of unlike length")).cast("double"), "zero": F.lit(0.0), "infinity": F.lit(float("inf"))}[mismatch]
    return F.when(F.size(a) == F.size(b), value).otherwise(other)
