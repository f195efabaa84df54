import pytest
from pyspark.sql import functions as F

from presslens.functions import urls as U



@pytest.mark.parametrize("url, expected", [
    ("https://site.com/news/world-12345678", True),
    ("https://site.com/india/a-long-slug/article123.cms", True),
    ("https://site.com/", False),
    ("https://site.com", False),
    ("https://site.com/uk", False),
    ("https://site.com/tag/politics/", False),
    ("https://site.com/TAG/politics/", False),
    ("https://site.com/category/india", False),
    ("https://site.com/author/john", False),
    ("https://site.com/search/?q=news", False),
    ("https://site.com/aboutface-x", False),
    ("https://site.com/terms-of-trade", False),
    ("https://site.com/news/x/?page=2", True),  # the query is not looked at
    ("https://site.com/abc;long-parameter", False),  # parameters are no path
    ("/relative/path", True),
    ("", False),
    (None, False),
])
def test_article_urls(evaluate, url, expected):
    assert evaluate(U.is_article_url(F.col("v")), [(url,)]) == [expected]


@pytest.mark.parametrize("url, expected", [
    ("https://www.BBC.co.uk/news", "bbc.co.uk"),
    ("https://timesofindia.com:8080/a", "timesofindia.com"),
    ("https://user:p@ss@host_name.org/a", "host_name.org"),
    ("//cdn.example.com/x", "cdn.example.com"),
    ("www.example.com/x", ""),
    ("mailto:a@b.c", ""),
    ("http://[2001:db8::1]/a", "2001:db8::1"),
    ("http://[2001:db8::1/a", "N/A"),
    ("https://www.www.example.com", "www.example.com"),
    ("httpbin", ""),
    ("", ""),
    (None, ""),
])
def test_domain(evaluate, url, expected):
    assert evaluate(U.url_domain(F.col("v")), [(url,)]) == [expected]


@pytest.mark.parametrize("source, expected", [
    (None, "u.com"), ("", "u.com"), ("N/A", "u.com"),
    ("BBC News", "BBC News"), ("www.bbc.co.uk", "www.bbc.co.uk"),
    ("https://www.bbc.co.uk", "bbc.co.uk"), ("httpbin", ""),
])
def test_clean_source(evaluate, source, expected):
    got = evaluate(U.clean_source(F.col("s"), F.col("u")), [(source, "https://www.u.com/a")],
                   "s string, u string")
    assert got == [expected]


def test_backfill_differs_without_host(evaluate):
    rows = [("", "https://www.u.com/a"), (None, "no-host"), ("N/A", None), ("kept", "https://u.com"),
            ("", "http://[bad/a")]
    got = evaluate(U.backfilled_source(F.col("s"), F.col("u")), rows, "s string, u string")
    assert got == ["u.com", "N/A", "N/A", "kept", ""]


def test_sitemap_guess(evaluate):
    got = evaluate(U.sitemap_guess(F.col("v")), [("https://a.com//",), ("https://a.com",), ("https://a.com/m.xml",)])
    assert got == ["https://a.com/sitemap.xml", "https://a.com/sitemap.xml", "https://a.com/m.xml"]
