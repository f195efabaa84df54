"""Scan of the stored, scored articles."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presslens import schemas
from presslens.functions.dates import parse_date


def load_articles(scored: DataFrame, newest_first: bool = True) -> DataFrame:
    """Scored rows with the 16 columns of the analyst views.

    The column list leaves out the article text, so the widest column is never
    read. Views that aggregate should pass ``newest_first=False`` and save the
    global sort.
    """
    strings = [c for c in schemas.LOAD_COLUMNS if c not in ("id", "date")
               and schemas.SENTIMENT_TYPES.get(c) != "double"]
    df = (
        scored.where(F.col("vader_compound").isNotNull())
        .select(*schemas.LOAD_COLUMNS)
        .na.fill(schemas.MISSING, strings)
        .withColumn("date", parse_date(F.col("date")))
    )
    return df.orderBy(F.desc("scraped_at"), "id") if newest_first else df


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """Parquet folder as a DataFrame; an empty one of the schema if nothing is there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def folder_exists(spark: SparkSession, path: str, schema) -> bool:
    try:
        spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def is_empty_store(spark: SparkSession, path: str) -> bool:
    """True when the store is missing or holds no rows: time for a first ingest."""
    return read_or_empty(spark, path, schemas.STORED).isEmpty()
