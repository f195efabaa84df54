"""CSV export of a run's articles, and reading it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presslens.schemas import ARTICLE, ARTICLE_COLUMNS

# Article texts hold quotes and line breaks; blanks at the ends must survive.
_OPTIONS = {
    "header": True, "quote": '"', "escape": '"', "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
    "nullValue": "", "emptyValue": "",
}

# A file with line breaks inside quotes is read by one task, so files stay small.
ROWS_PER_FILE = 100_000


def export_csv(articles: DataFrame, folder: str, stamp: str) -> str:
    """Write the eleven article columns; returns the path, ``''`` without rows."""
    if articles.isEmpty():
        return ""
    path = f"{folder}/news_{stamp}.csv"
    (
        articles.select(ARTICLE_COLUMNS)
        .write.mode("overwrite")
        .options(**_OPTIONS)
        .option("maxRecordsPerFile", ROWS_PER_FILE)
        .csv(path)
    )
    return path


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Read an export; CSV has no NULL, so missing values come back empty."""
    df = (
        spark.read.schema(ARTICLE).options(**_OPTIONS).option("multiLine", True).csv(path)
    )
    return df.na.fill("", ARTICLE_COLUMNS)
