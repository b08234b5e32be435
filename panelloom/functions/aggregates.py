"""Aggregate expressions. All have partial (map-side) forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def compound(returns: Column) -> Column:
    """Geometric compounding of simple returns; exact also for a total loss (-1)."""
    return F.product(returns + F.lit(1.0)) - F.lit(1.0)


def weighted_mean(value: Column, weight: Column) -> Column:
    kept = F.when(value.isNotNull(), weight)
    return F.sum(value * weight) / F.nullif(F.sum(kept), F.lit(0))


def variation_coefficient(value: Column, min_count: int = 3) -> Column:
    """Population standard deviation over mean, NULL under `min_count` values or for a zero mean."""
    ratio = F.stddev_pop(value) / F.nullif(F.avg(value), F.lit(0.0))
    return F.when(F.count(value) >= min_count, ratio)


def count_where(predicate: Column) -> Column:
    return F.count_if(F.coalesce(predicate, F.lit(False)))


def null_count(name: str) -> Column:
    return F.count_if(F.col(name).isNull())


def first_where(predicate: Column, value: Column) -> Column:
    return F.min(F.when(predicate, value))


def last_where(predicate: Column, value: Column) -> Column:
    return F.max(F.when(predicate, value))
