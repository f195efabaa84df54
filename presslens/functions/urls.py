"""URL parts and the predicates built on them.

The patterns follow RFC 3986 splitting and never raise, unlike ``parse_url``,
which fails on bad URLs and gives NULL for hosts with an underscore.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from presslens.functions.text import or_missing
from presslens.schemas import MISSING

HOST_RE = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#]*@)?(?:\[([^\]]+)\]|([^/:?#\[]+))"
NETLOC_RE = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)"
PATH_RE = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"
PATH_PARAMS_RE = r";[^/]*$"

# Path parts that mark a page as not being an article.
SKIP_PATTERNS = [
    "/tag/", "/tags/", "/category/", "/author/",
    "/page/", "/feed/", "/search/", "/?", "/about",
    "/contact", "/privacy", "/terms",
]

MIN_PATH_LENGTH = 5


def _skip_regex() -> str:
    return "|".join(p.replace("?", "[?]") for p in SKIP_PATTERNS)


def stripped(url: Column) -> Column:
    """A URL without the blanks and control characters around it."""
    return F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def url_host(url: Column) -> Column:
    """Lower-case host, ``''`` when there is none."""
    url = stripped(url)
    host = F.concat(F.regexp_extract(url, HOST_RE, 1), F.regexp_extract(url, HOST_RE, 2))
    return F.coalesce(F.lower(host), F.lit(""))


def has_bad_host(url: Column) -> Column:
    """True for an authority with an unpaired bracket, which URL parsers refuse."""
    netloc = F.regexp_extract(stripped(url), NETLOC_RE, 1)
    return F.coalesce(F.contains(netloc, F.lit("[")) != F.contains(netloc, F.lit("]")), F.lit(False))


def url_domain(url: Column) -> Column:
    """Host without one leading ``www.``; ``''`` without host, ``N/A`` if unparsable."""
    return F.when(has_bad_host(url), F.lit(MISSING)).otherwise(
        F.regexp_replace(url_host(url), r"^www[.]", "")
    )


def url_path(url: Column) -> Column:
    """Path without query, fragment and last-segment parameters."""
    return F.regexp_replace(F.regexp_extract(stripped(url), PATH_RE, 1), PATH_PARAMS_RE, "")


def is_article_url(url: Column) -> Column:
    """Path of at least five characters that holds no skip pattern."""
    path = F.lower(url_path(url))
    return F.coalesce(
        (F.length(path) >= MIN_PATH_LENGTH) & ~path.rlike(_skip_regex()), F.lit(False)
    )


def is_missing(value: Column) -> Column:
    """NULL, empty or the ``N/A`` sentinel."""
    return value.isNull() | value.isin("", MISSING)


def clean_source(source: Column, url: Column) -> Column:
    """Source name; falls back to the URL's domain, and cuts source URLs to a domain."""
    return (
        F.when(is_missing(source), url_domain(url))
        .when(source.startswith("http"), url_domain(source))
        .otherwise(source)
    )


def backfilled_source(source: Column, url: Column) -> Column:
    """Domain where the source is missing (``N/A`` without host); else unchanged."""
    return F.when(is_missing(source) & ~has_bad_host(url), or_missing(url_domain(url))).otherwise(
        source
    )


def base_url(site: Column) -> Column:
    """Site URL without trailing slashes."""
    return F.regexp_replace(site, r"/+$", "")


def sitemap_guess(site: Column) -> Column:
    """A sitemap URL as it is; for a homepage, ``/sitemap.xml`` appended."""
    return F.when(site.endswith(".xml"), site).otherwise(
        F.concat(base_url(site), F.lit("/sitemap.xml"))
    )


def absolute_href(href: Column, base: Column) -> Column:
    """Root-relative links get the base in front; others stay."""
    return F.when(href.startswith("/"), F.concat(base, href)).otherwise(href)
