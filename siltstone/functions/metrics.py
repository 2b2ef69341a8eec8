"""Retrieval and answer metrics over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _hits(retrieved: Column, relevant: Column, k: int) -> Column:
    return F.size(F.filter(F.slice(retrieved, 1, k), lambda x: F.array_contains(relevant, x)))


def precision_at(retrieved: Column, relevant: Column, k: int) -> Column:
    return _hits(retrieved, relevant, k) / F.lit(float(k))


def recall_at(retrieved: Column, relevant: Column, k: int, total: Column | None = None) -> Column:
    """total: how many relevant ones there are, where not all are listed."""
    n = F.size(relevant) if total is None else total
    return F.when(n > 0, F.size(F.array_intersect(F.slice(retrieved, 1, k), relevant)) / n).otherwise(0.0)


def reciprocal_rank(retrieved: Column, relevant: Column) -> Column:
    first = F.array_min(F.filter(F.transform(retrieved, lambda x, i: F.when(F.array_contains(relevant, x), i + 1)), lambda r: r.isNotNull()))
    return F.coalesce(F.lit(1.0) / first, F.lit(0.0))


def ndcg_at(retrieved: Column, relevant: Column, k: int, total: Column | None = None) -> Column:
    """Binary gain; a relevant item that comes repeatedly counts each time.  total: as in recall_at."""
    add = lambda acc, x: acc + x
    dcg = F.aggregate(F.transform(F.slice(retrieved, 1, k), lambda x, i: F.when(F.array_contains(relevant, x), 1.0 / F.log2(i + 2.0)).otherwise(0.0)), F.lit(0.0), add)
    n = F.least(F.size(relevant) if total is None else total, F.lit(k)).cast("int")
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: 1.0 / F.log2(i + 1.0)), F.lit(0.0), add)
    return F.when(n > 0, dcg / ideal).otherwise(0.0)


def contains_expected(answer: Column, keywords: Column, must_abstain: Column) -> Column:
    return must_abstain | F.exists(keywords, lambda k: F.contains(answer, k))


def middle_value(values: Column) -> Column:
    """The value at place n div 2 of the sorted values."""
    return F.element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def coerced_score(text: Column, default: float = 0.0) -> Column:
    """A score in free text: a/b, p %, or a number on a scale of 1, 5 or 10."""
    a, b = (F.regexp_extract(text, r"(\d+(?:\.\d+)?)\s*/\s*(\d+(?:\.\d+)?)", i) for i in (1, 2))
    share = F.regexp_extract(text, r"(\d+(?:\.\d+)?)\s*%", 1)
    number = F.regexp_extract(text, r"(-?\d+(?:\.\d+)?)", 1)
    v = number.try_cast("double")
    return (
        F.when(a != "", F.when(b.try_cast("double") == 0, default).otherwise(a.try_cast("double") / b.try_cast("double")))
        .when(share != "", share.try_cast("double") / 100)
        .when(number == "", default)
        .when((v > 1) & (v <= 5), v / 5)
        .when((v > 5) & (v <= 10), v / 10)
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))
    )
