"""Exact ratios rounded half to even.

Percentages and means are ratios of whole numbers. Rounding them on whole
numbers gives the same digits whatever order the rows were summed in.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even_ratio(num: Column, den: Column, digits: int) -> Column:
    """``num / den`` rounded half-even to ``digits`` places; NULL when ``den`` is 0.

    The decimal quotient has 15 places, which tells a tie from its neighbours
    for any denominator below 10^14.
    """
    quotient = num.cast("decimal(16,0)") * F.lit(10 ** digits) / den.cast("decimal(14,0)")
    return F.when(den != 0, F.bround(quotient, 0).cast("double") / F.lit(float(10 ** digits)))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """``part`` of ``whole`` in percent, half-even; NULL for an empty whole."""
    return half_even_ratio(part.cast("bigint") * 100, whole, digits)


def ten_thousandths(score: Column) -> Column:
    """A 4-digit score as a whole number of 1/10000, for order-free sums."""
    return F.round(score * 10000).cast("bigint")


def mean_of_scores(score: Column, digits: int = 3) -> Column:
    """Aggregate: mean of 4-digit scores, half-even to at most 4 places."""
    return half_even_ratio(
        F.sum(ten_thousandths(score)), F.count(score) * F.lit(10 ** (4 - digits)), 0
    ) / F.lit(float(10 ** digits))


def thousands(n: Column) -> Column:
    """A whole number with thousands separators."""
    return F.format_number(n, 0)
