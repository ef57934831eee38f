"""Array functions (ARR-*)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distinct_ignoring_case(arr: Column) -> Column:
    """Order stays, the first spelling wins."""
    low = F.transform(arr, F.lower)
    return F.filter(arr, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def without_ignoring_case(arr: Column, other: Column) -> Column:
    low = F.transform(other, F.lower)
    return F.filter(arr, lambda x: ~F.array_contains(low, F.lower(x)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def mean(arr: Column) -> Column:
    """Null if empty."""
    return F.when(F.size(arr) > 0, F.aggregate(arr, F.lit(0.0), lambda t, x: t + x) / F.size(arr))
