"""Reading landed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(scan: DataFrame) -> DataFrame:
    """A table scan with work for every core.

    A small table is one file with one row group, which one core reads; costly
    work per row would stay on that core. A table with at least as many splits
    as cores, as any large one, is returned as it is. Only for scans: the number
    of splits is known there without running anything.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
