"""Distinct rows that keep the first occurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each ``key`` by the order columns.

    ``row_number = 1`` lets Spark keep one row per key in each task before the
    shuffle, so a key that holds a third of all rows stays cheap.
    """
    first = Window.partitionBy(key).orderBy(*order)
    return (
        df.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") == 1).drop("_rn")
    )
