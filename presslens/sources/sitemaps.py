"""Sitemap expansion over landed documents ``(doc_url, xml)``.

A site's start document may be an index; its first five children are read, and
so are theirs, down to depth 2. Deeper documents are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presslens.functions.html import unescape
from presslens.functions.once import with_once
from presslens.functions.text import all_matches
from presslens.functions.urls import is_article_url, sitemap_guess

SITEMAP_SCHEMA = (
    "sitemap array<struct<loc: string>>, url array<struct<loc: string>>, "
    "loc array<string>, _corrupt_record string"
)
LOC_RE = r"(?s)<loc>([^<]*(?:<!\[CDATA\[[^\]]*\]\]>)?[^<]*)</loc>"
CHILD_RE = r"(?s)<sitemap>\s*<loc>([^<]*(?:<!\[CDATA\[[^\]]*\]\]>)?[^<]*)</loc>"
CDATA_RE = r"<!\[CDATA\[|\]\]>"

MAX_CHILDREN = 5
MAX_DEPTH = 2
#: From this cap on, URLs of a site are cut in two steps, first in this many sub-groups.
TWO_STEP_FROM = 1000
SALTS = 16


def parse_sitemaps(docs: DataFrame, max_urls: int) -> DataFrame:
    """``(doc_url, children, locs)``: child sitemaps of an index, or article URLs.

    Parsing happens once per document, before any join. An index has no URLs of
    its own. One document can give a site at most ``max_urls`` URLs, so its list
    is cut to that here already. A malformed document gives what can be read of it.
    Of a document that landed more than once the newest counts, by ``landed_at`` if
    there is such a column; only the short lists move for that.
    """
    read = _entries(docs)
    articles = F.slice(F.filter("_locs", lambda u: u.isNotNull() & is_article_url(u)), 1, max_urls)
    landed = F.col("landed_at") if "landed_at" in docs.columns else F.lit(0)
    lists = read.select(
        "doc_url", landed.alias("landed"),
        F.when(F.col("_nested"), F.slice("_children", 1, MAX_CHILDREN)).alias("children"),
        F.when(~F.col("_nested"), articles).alias("locs"),
    )
    newest = lists.groupBy("doc_url").agg(F.max(F.struct("landed", "children", "locs")).alias("newest"))
    return newest.select("doc_url", "newest.children", "newest.locs")


def _entries(docs: DataFrame) -> DataFrame:
    """Documents with ``_malformed``, ``_nested``, ``_children`` and ``_locs``."""
    parsed = with_once(docs, "_map", F.from_xml("xml", F.lit(SITEMAP_SCHEMA), {"mode": "PERMISSIVE"}))
    none = F.array().cast("array<string>")

    def texts(xml: Column, pattern: str) -> Column:
        return F.transform(all_matches(xml, pattern, 1), lambda s: unescape(F.regexp_replace(F.trim(s), CDATA_RE, "")))

    parts = parsed.withColumn("_malformed", F.col("_map._corrupt_record").isNotNull()).select(
        "*",
        F.when(F.col("_malformed"), texts(F.col("xml"), CHILD_RE)).otherwise(
            F.coalesce(F.transform("_map.sitemap", lambda s: F.trim(s["loc"])), none)).alias("_children"),
        F.when(F.col("_malformed"), texts(F.col("xml"), LOC_RE)).otherwise(F.concat(
            F.coalesce(F.transform("_map.url", lambda u: F.trim(u["loc"])), none),
            F.coalesce(F.transform("_map.loc", lambda u: F.trim(u)), none),
        )).alias("_locs"),
    )
    return parts.withColumn("_nested", F.size("_children") > 0)


def sitemap_health(docs: DataFrame) -> DataFrame:
    """``(doc_url, status, malformed, n_locs)`` of each landed document: failed (nothing
    could be read), empty, index or ok."""
    n = F.when(F.col("_nested"), F.size("_children")).otherwise(F.size("_locs"))
    return _entries(docs).select(
        "doc_url",
        F.when((n == 0) & F.col("_malformed"), "failed").when(n == 0, "empty").when(F.col("_nested"), "index")
        .otherwise("ok").alias("status"),
        F.col("_malformed").alias("malformed"), n.cast("bigint").alias("n_locs"),
    )


def sitemap_urls(sites: DataFrame, docs: DataFrame, max_urls: int = 30) -> DataFrame:
    """First article URLs of each site in document order, ``(src_ord, site, pos, url)``.

    ``sites(src_ord, site)``, ``docs(doc_url, xml)`` and perhaps ``landed_at``.
    """
    return walk_sitemaps(sites, parse_sitemaps(docs, max_urls), max_urls)


def walk_sitemaps(sites: DataFrame, parsed: DataFrame, max_urls: int = 30) -> DataFrame:
    """The same from parsed documents, e.g. a written ``parse_sitemaps`` table.

    The number of levels is fixed, so the walk is one equi join per level, over
    narrow ``(parent, child)`` edges only; AQE splits a child that many sites
    share. URL lists are joined once, to all documents reached. The cap per site
    is a ``row_number`` filter, which Spark applies in each task before the
    shuffle too.
    """
    edges = parsed.select("doc_url", F.posexplode("children").alias("child", "child_url")).where(
        F.col("child_url").isNotNull()
    )
    level = sites.select(
        "src_ord", "site",
        sitemap_guess(F.col("site")).alias("doc_url"),
        F.array().cast("array<int>").alias("path"),
    )
    reached = level
    for _ in range(MAX_DEPTH):
        level = level.join(edges, "doc_url").select(
            "src_ord", "site", F.col("child_url").alias("doc_url"),
            F.concat("path", F.array("child")).alias("path"),
        )
        reached = reached.unionByName(level)
    found = reached.join(parsed.select("doc_url", "locs"), "doc_url").select(
        "src_ord", "site", "path", F.posexplode("locs").alias("loc_pos", "url")
    )
    if max_urls >= TWO_STEP_FROM:
        # a large cap: first within sub-groups of a site, so that one task ranks at
        # most SALTS * max_urls rows of it
        salt = F.pmod(F.xxhash64(F.to_json("path"), "loc_pos"), F.lit(SALTS))
        first = Window.partitionBy("src_ord", "site", "_salt").orderBy("path", "loc_pos")
        found = (found.withColumn("_salt", salt).withColumn("_first", F.row_number().over(first))
                 .where(F.col("_first") <= max_urls).drop("_salt", "_first"))
    in_order = Window.partitionBy("src_ord", "site").orderBy("path", "loc_pos")
    return (
        found.withColumn("pos", F.row_number().over(in_order))
        .where(F.col("pos") <= max_urls)
        .select("src_ord", "site", (F.col("pos") - 1).alias("pos"), "url")
    )
