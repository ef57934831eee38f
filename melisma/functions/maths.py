"""Number functions (MTH-*)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def round_half_up(x: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(x + 0.5)


def leading_int(s: Column) -> Column:
    """The integer that a text begins with, after white space; null without one."""
    return F.nullif(F.regexp_extract(s, r"^\s*([+-]?\d+)", 1), F.lit("")).try_cast("int")


def mood(s: Column) -> Column:
    """A mood tag as 0 to 99; unreadable counts as 0."""
    return clamp(F.coalesce(leading_int(s), F.lit(0)), 0, 99)


def score_band(x: Column) -> Column:
    return F.when(x >= 0.8, "high").when(x >= 0.5, "medium").otherwise("low")


def slider(x: float, lo: int = 0, hi: int = 9) -> int:
    """A slider's position, rounded half up and clamped."""
    return max(lo, min(hi, math.floor(x + 0.5)))


def page_bounds(page: int = 1, size: int = 48, most: int = 100) -> tuple[int, int]:
    """(rows to skip, rows to take)."""
    size = max(1, min(most, size))
    return (max(1, page) - 1) * size, size
