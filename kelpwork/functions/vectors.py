"""Similarity of dense vectors (arrays) and sparse ones (maps), as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column, strict: bool = True) -> Column:
    """Cosine; 0 where a norm is 0. Vectors of different lengths raise, or give 0 if not ``strict``."""
    size = norm(a) * norm(b)
    value = F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)
    apart = F.size(a) != F.size(b)
    return F.when(apart, F.raise_error(F.lit("vectors of different lengths")).cast("double") if strict else F.lit(0.0)).otherwise(value)


def total(m: Column) -> Column:
    return F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Sum of the smaller weights of shared keys over the sum of the larger ones; 0 for nothing shared or a null."""
    shared = F.aggregate(F.array_intersect(F.map_keys(a), F.map_keys(b)), F.lit(0.0), lambda s, k: s + F.least(F.try_element_at(a, k), F.try_element_at(b, k)))
    whole = total(a) + total(b) - shared
    return F.coalesce(F.when(whole > 0, shared / whole), F.lit(0.0))


def hybrid(dense: Column, sparse: Column, alpha: float = 0.7) -> Column:
    return F.lit(alpha) * dense + F.lit(1 - alpha) * sparse


def compression(whole: Column, short: Column) -> Column:
    """Ratio of two sizes, 1 where it cannot be told."""
    return F.coalesce(F.when((whole > 0) & (short > 0), whole / short), F.lit(1.0))
