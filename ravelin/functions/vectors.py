"""Column expressions over vectors (arrays of numbers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero; null if one is null or their sizes differ."""
    n = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n))


def mean(a: Column, b: Column) -> Column:
    """Elementwise mean, not normed again; a where b is null or of another size."""
    both = F.zip_with(a, b, lambda x, y: ((x.cast("double") + y.cast("double")) / 2).cast("float"))
    return F.when(b.isNotNull() & (F.size(a) == F.size(b)), both).otherwise(a)
