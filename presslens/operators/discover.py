"""Combined discovery: feeds first, then sitemaps, one URL kept once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslens.operators.dedupe import keep_first
from presslens.sources.feeds import feed_items
from presslens.sources.sitemaps import walk_sitemaps

ORDER = ("kind", "src_ord", "source_url", "pos")


def discovered_raw(
    feeds: DataFrame, sites: DataFrame, sitemaps: DataFrame, max_per_source: int = 10
) -> DataFrame:
    """All URLs with their order: ``(kind, src_ord, source_url, pos, url)``.

    ``sitemaps`` come from ``parse_sitemaps``, best as a written table: the walk
    reads them more than once.
    """
    rss = feed_items(feeds, max_per_source).select(
        F.lit(1).alias("kind"), "src_ord", F.col("feed_url").alias("source_url"), "pos", "url"
    )
    maps = walk_sitemaps(sites, sitemaps, max_per_source).select(
        F.lit(2).alias("kind"), "src_ord", F.col("site").alias("source_url"), "pos", "url"
    )
    return rss.unionByName(maps)


def discover_all(
    feeds: DataFrame, sites: DataFrame, sitemaps: DataFrame, max_per_source: int = 10
) -> DataFrame:
    """Each discovered URL once, at its first place."""
    return keep_first(discovered_raw(feeds, sites, sitemaps, max_per_source), "url", *ORDER)


def discover_counts(raw: DataFrame) -> DataFrame:
    """Raw, unique and duplicate URL counts."""
    return (
        raw.groupBy("url")
        .agg(F.count("*").alias("n"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("raw_urls"),
            F.count("*").alias("unique_urls"),
        )
        .withColumn("duplicate_urls", F.col("raw_urls") - F.col("unique_urls"))
    )
