"""Vector expressions over array columns, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + F.lit(EPSILON))


def unit(a: Column) -> Column:
    n = norm(a) + F.lit(EPSILON)
    return F.transform(a, lambda x: x.cast("double") / n)


def hashed_bag(tokens: Column, dim: int) -> Column:
    """Unit vector of token counts in dim hash buckets."""
    buckets = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(dim)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(buckets, lambda b: b == i)).cast("double"))
    return unit(counts)


def signature_similarity(a: Column, b: Column) -> Column:
    """Share of equal places of two signatures of equal length, else 0."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)), same / F.size(a)).otherwise(0.0)


def round_half_even(x: Column, digits: int) -> Column:
    return F.bround(x, digits)
