"""Store statistics and run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslens.functions.numbers import percent
from presslens.functions.text import cut, cut_with_dots
from presslens.schemas import MISSING

BAR_WIDTH = 20


def _bar(n: str, width: int):
    return F.repeat(F.lit("█"), F.least(F.col(n), F.lit(width)).cast("int"))


def beside(*parts: DataFrame) -> DataFrame:
    """One-row frames with different columns put into one row, without a join."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def db_stats(store: DataFrame, day: str) -> DataFrame:
    """Total articles and those scraped on a day, in one pass."""
    return store.agg(
        F.count("*").alias("total_articles"),
        F.count_if(F.col("scraped_at").startswith(day)).alias("articles_today"),
    )


def _top(store: DataFrame, column: str, n: int) -> DataFrame:
    return (
        store.where(F.col(column) != MISSING)
        .groupBy(column)
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), column)
        .limit(n)
    )


def top_sources(store: DataFrame, n: int = 5) -> DataFrame:
    """Most frequent sources; NULL and ``N/A`` are out, an empty name counts."""
    return _top(store, "source", n)


def top_languages(store: DataFrame, n: int = 5) -> DataFrame:
    return _top(store, "language", n)


def source_bars(store: DataFrame, n: int = 5) -> DataFrame:
    """Top sources with a bar of at most 20 blocks."""
    return top_sources(store, n).withColumn("bar", _bar("n", BAR_WIDTH))


def extractor_breakdown(articles: DataFrame) -> DataFrame:
    """Articles per extraction strategy, most frequent first."""
    return (
        articles.groupBy("extracted_by")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "extracted_by")
    )


def preview(articles: DataFrame, n: int = 5, order: str = "id") -> DataFrame:
    """First articles of a run with long fields cut for display."""
    return articles.orderBy(order).limit(n).select(
        order, "title", "source", "authors", "date", "language",
        cut(F.col("tags"), 80).alias("tags"), "extracted_by",
        cut_with_dots(F.col("summary"), 100).alias("summary"),
    )


def run_summary(
    discovered: DataFrame, extract_counts: DataFrame, insert_counts: DataFrame
) -> DataFrame:
    """One row for a whole run, from one-row count frames.

    ``discovered(n)``, ``extract_counts(scraped, ...)``,
    ``insert_counts(inserted, duplicates)``. What was discovered and not scraped
    has failed, be it for want of a landed page or of an acceptable text.
    """
    row = beside(
        discovered.select(F.col("n").alias("urls_discovered")),
        extract_counts.select("scraped"),
        insert_counts.select("inserted", "duplicates"),
    )
    return row.select(
        "urls_discovered", "scraped", F.col("inserted").alias("new_in_store"), "duplicates",
        (F.col("urls_discovered") - F.col("scraped")).alias("failed"),
        percent(F.col("scraped"), F.col("urls_discovered")).alias("success_pct"),
    )
