"""Costly columns that are computed once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later filters and projections read but never repeat.

    A filter on a projected column is pushed below the projection, and takes a
    copy of the expression with it: the work is done twice. Filters on a
    generator's output stay above it.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
