"""Feed scans over landed feed documents ``(src_ord, feed_url, xml)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presslens.functions.html import unescape
from presslens.functions.once import with_once
from presslens.functions.text import all_matches, let, or_null
from presslens.functions.urls import absolute_href, base_url

# One schema for all dialects: RSS has channel/item/link, RSS 1.0 has its items beside the
# channel, Atom has entry/link/@href.
_ITEMS = "array<struct<title: string, link: string, guid: struct<_VALUE: string, _isPermaLink: string>>>"
FEED_SCHEMA = (
    f"channel struct<item: {_ITEMS}>, item {_ITEMS}, "
    "entry array<struct<title: string, link: array<struct<_href: string, _rel: string>>>>, "
    "_corrupt_record string"
)

# Paths under a site where a feed is usually found, in this order.
FEED_SUFFIXES = [
    "/feed", "/feed/", "/rss", "/rss/", "/rss.xml",
    "/feed.xml", "/atom.xml", "/news/rss", "/feeds/posts/default",
]

FEED_LINK_TYPE = "application/rss+xml"

ENTRY_RE = r"(?is)<item\b.*?</item>|<entry\b.*?</entry>"
LINK_TEXT_RE = r"(?is)<link>(.*?)</link>"
LINK_TAG_RE = r"(?is)<link\b[^>]*>"
CDATA_RE = r"<!\[CDATA\[|\]\]>"


def _atom_link(links: Column) -> Column:
    """The first alternate link of an Atom entry (no ``rel`` counts as alternate)."""
    alternate = F.filter(
        links, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"
    )
    return F.get(F.transform(alternate, lambda x: x["_href"]), F.lit(0))


def _item_link(item: Column) -> Column:
    """An item's link, else its permanent identifier (which a ``guid`` is unless it says no)."""
    permanent = F.coalesce(F.lower(item["guid"]["_isPermaLink"]), F.lit("true")) != "false"
    return F.coalesce(or_null(F.trim(item["link"])), F.when(permanent, or_null(F.trim(item["guid"]["_VALUE"]))))


def _salvaged_links(xml: Column) -> Column:
    """Links of the whole entries in a malformed document, as a lenient reader sees them."""

    def link(entry: Column) -> Column:
        alternate = F.filter(
            all_matches(entry, LINK_TAG_RE),
            lambda tag: _attribute(tag, "rel").isin("", "alternate") & (_attribute(tag, "href") != ""),
        )
        text = F.regexp_replace(F.regexp_extract(entry, LINK_TEXT_RE, 1), CDATA_RE, "")
        return unescape(F.coalesce(
            or_null(F.trim(text)), F.get(F.transform(alternate, lambda t: _attribute(t, "href")), F.lit(0))
        ))

    return F.transform(all_matches(xml, ENTRY_RE), link)


def parse_feeds(feeds: DataFrame) -> DataFrame:
    """Add ``links`` (one element per entry, NULL without link) and ``malformed``."""
    parsed = with_once(
        feeds, "_feed", F.from_xml("xml", F.lit(FEED_SCHEMA), {"mode": "PERMISSIVE"})
    )
    rss = F.transform(F.coalesce("_feed.channel.item", "_feed.item"), _item_link)
    atom = F.transform(F.col("_feed.entry"), lambda entry: F.trim(_atom_link(entry["link"])))
    malformed = F.col("_feed._corrupt_record").isNotNull()
    no_links = F.array().cast("array<string>")
    return parsed.select(
        "src_ord",
        "feed_url",
        F.coalesce(F.when(malformed, _salvaged_links(F.col("xml"))), rss, atom, no_links).alias("links"),
        malformed.alias("malformed"),
    )


def feed_items(feeds: DataFrame, max_per_feed: int = 10) -> DataFrame:
    """URLs of the first entries of each feed, ``(src_ord, feed_url, pos, url)``.

    The cap counts entries, also those without a link. It is a slice of the
    parsed array, so nothing is shuffled.
    """
    return (
        parse_feeds(feeds)
        .select(
            "src_ord", "feed_url",
            F.posexplode(F.slice("links", 1, max_per_feed)).alias("pos", "url"),
        )
        .where(F.col("url").isNotNull() & (F.col("url") != ""))
    )


def feed_health(feeds: DataFrame, max_per_feed: int = 10) -> DataFrame:
    """Status (failed / empty / ok) and URL count of each feed."""
    usable = F.filter(
        F.slice("links", 1, max_per_feed), lambda u: u.isNotNull() & (u != "")
    )
    entries = F.size("links")
    return parse_feeds(feeds).select(
        "feed_url",
        F.when((entries == 0) & F.col("malformed"), "failed")
        .when(entries == 0, "empty")
        .otherwise("ok")
        .alias("status"),
        F.size(usable).cast("bigint").alias("n_urls"),
    )


def probe_pick(sites: DataFrame, probes: DataFrame) -> DataFrame:
    """First usual feed path of each site whose probe answered 200 with XML.

    ``sites(site)``, ``probes(url, status, content_type)``; gives ``(site,
    feed_url)`` with NULL for a site where nothing fitted.
    """
    suffixes = F.array(*[F.lit(s) for s in FEED_SUFFIXES])
    found = (
        probes.where((F.col("status") == 200) & F.contains("content_type", F.lit("xml")))
        .select("url")
        .distinct()
        .withColumn("hit", F.lit(True))
    )
    tried = sites.select("site", F.posexplode(suffixes).alias("ord", "suffix")).withColumn(
        "url", F.concat(base_url(F.col("site")), "suffix")
    )
    return (
        tried.join(found, "url", "left")
        .groupBy("site")
        .agg(F.min(F.when(F.col("hit"), F.col("ord"))).alias("ord"))
        .select("site", F.concat(base_url(F.col("site")), F.get(suffixes, F.col("ord"))).alias("feed_url"))
    )


def _attribute(tag: Column, name: str) -> Column:
    """Value of an HTML attribute, whichever quotes it has; ``''`` without it."""
    pattern = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.concat(*[F.regexp_extract(tag, pattern, g) for g in (1, 2, 3)])


def feed_link(html: Column, site: Column) -> Column:
    """Feed link in a page: the first ``<link rel=alternate>`` of the feed type."""
    tags = all_matches(F.regexp_replace(html, r"(?is)<!--.*?-->", " "), LINK_TAG_RE)
    feed_tags = F.filter(
        tags,
        lambda tag: F.array_contains(F.split(_attribute(tag, "rel"), r"\s+"), F.lit("alternate"))
        & (_attribute(tag, "type") == FEED_LINK_TYPE),
    )
    return let(F.get(feed_tags, F.lit(0)), lambda tag: absolute_href(
        or_null(_attribute(tag, "href")), base_url(site)
    ))


def find_feeds(homepages: DataFrame, probes: DataFrame) -> DataFrame:
    """Feed of each homepage ``(site, html)``: by probe, else by link in the page."""
    linked = homepages.select("site", feed_link(F.col("html"), F.col("site")).alias("from_html"))
    probed = probe_pick(homepages.select("site"), probes).withColumnRenamed("feed_url", "from_probe")
    return linked.join(probed, "site", "left").select(
        "site", "from_probe", "from_html",
        F.coalesce("from_probe", "from_html").alias("feed_url"),
    )
