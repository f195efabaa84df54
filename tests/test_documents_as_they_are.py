"""Dates, references, badges, feeds and sitemaps as real documents have them."""

import html
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from presslens.functions.dates import day_of, parse_date
from presslens.functions.html import unescape
from presslens.functions.labels import score_badge, three_digits
from presslens.functions.text import content_words
from presslens.functions.urls import url_domain
from presslens.sources import feeds, sitemaps


@pytest.mark.parametrize("text, expected", [
    ("Jan 12, 2025", "2025-01-12"), ("January 12, 2025", "2025-01-12"), ("Thu, 02 Jan 2025 08:00:00 GMT", "2025-01-02"),
    ("Thu, 2 Jan 2025 23:59:59 +0530", "2025-01-02"), ("2025-01-02T23:30:00-05:00", "2025-01-02"),
    ("2025-01-02T08:00:00.123Z", "2025-01-02"), ("2025-01-02 08:00", "2025-01-02"), ("2025/01/02", "2025-01-02"),
    ("2 January 2025", "2025-01-02"), ("20250102", "2025-01-02"), (" 2025-01-02 ", "2025-01-02"),
    ("N/A", None), ("", None), (None, None), ("yesterday", None), ("2025-13-45", None),
])
def test_days(evaluate, text, expected):
    assert evaluate(day_of(F.col("v")), [(text,)]) == [expected]


def test_times_are_those_the_text_shows(evaluate):
    got = evaluate(parse_date(F.col("v")), [("2025-01-02T23:30:00-05:00",), ("Fri, 03 Jan 2025 10:00:00 +0100",)])
    assert got == [datetime(2025, 1, 2, 23, 30), datetime(2025, 1, 3, 10)]


@pytest.mark.parametrize("text", [
    "It&#8217;s caf&eacute;", "a &amp;lt; b", "&#x1F600;&#128512;", "&lt;p&gt; &quot;x&quot; &apos;", "no reference & here; &",
    "&unknown; &euro;&hellip;", "", None,
])
def test_references(evaluate, text):
    assert evaluate(unescape(F.col("v")), [(text,)]) == [text if text is None else html.unescape(text)]


def test_a_reference_to_no_character_stays(evaluate):
    assert evaluate(unescape(F.col("v")), [("&#0; &#xD800; &#1114112; a&nbsp;b",)]) == ["&#0; &#xD800; &#1114112; a b"]


def test_three_digits_of_all_four_digit_scores(spark):
    df = spark.range(-10_000, 10_001).select((F.col("id") / 10_000).alias("s"))
    wrong = [(r.s, r.t) for r in df.select("s", three_digits(F.col("s")).alias("t")).collect() if r.t != f"{r.s:.3f}"]
    assert not wrong
    odd = [0.0, -0.0, 1e-9, -1e-9, 0.5 ** 11, 3 * 0.5 ** 11, 0.0005, 0.0015, 0.9995, 3.9995, -2.0625]
    rows = spark.createDataFrame([(x,) for x in odd], "s double").select(three_digits(F.col("s"))).collect()
    assert [r[0] for r in rows] == [f"{x:.3f}" for x in odd]


def test_badges(spark):
    df = spark.createDataFrame([(0.1235,), (0.0005,), (-0.0003,), (-0.05,), (0.05,), (-0.5,)], "s double")
    got = [tuple(r[0]) for r in df.select(score_badge(F.col("s"))).collect()]
    assert got == [("score-pos", "+0.123"), ("score-neu", "0.001"), ("score-neu", "-0.000"),
                   ("score-neu", "-0.050"), ("score-neu", "0.050"), ("score-neg", "-0.500")]


def test_words_with_combining_marks(evaluate):
    assert evaluate(content_words(F.col("v")), [("हिन्दी में समाचार é",)]) == [["हिन्दी", "में", "समाचार"]]


def test_blanks_around_a_url(evaluate):
    rows = [(" \t https://www.a.com/x ",), ("\x01http://b.org",)]
    assert evaluate(url_domain(F.col("v")), rows) == ["a.com", "b.org"]


RSS1 = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/">
<channel><title>t</title></channel><item><title>a</title><link>https://x/1</link></item><item><link> https://x/2 </link></item></rdf:RDF>"""
GUIDS = """<rss><channel><item><guid>https://x/1</guid></item><item><guid isPermaLink="false">7</guid></item>
<item><link>https://x/3</link><guid isPermaLink="true">https://y/3</guid></item></channel></rss>"""


@pytest.mark.parametrize("xml, urls", [(RSS1, ["https://x/1", "https://x/2"]), (GUIDS, ["https://x/1", "https://x/3"])])
def test_feeds(spark, xml, urls):
    df = spark.createDataFrame([(1, "f", xml)], "src_ord int, feed_url string, xml string")
    assert [r.url for r in feeds.feed_items(df).orderBy("pos").collect()] == urls
    assert feeds.feed_health(df).first()["status"] == "ok"


def loc(n):
    return f"<url><loc>https://a.com/news/{n}?a=1&amp;b=2</loc></url>"


@pytest.mark.parametrize("xml, n, status, malformed", [
    (f"<urlset>{loc(1)}{loc(2)}</urlset>", 2, "ok", False), (f"<urlset>{loc(1)}{loc(2)}<url><loc>https://a.com/cut", 2, "ok", True),
    (f"<urlset><note>a & b</note>{loc(1)}</urlset>", 1, "ok", True), ("<urlset></urlset>", 0, "empty", False), ("not xml", 0, "failed", True),
    ("<sitemapindex><sitemap><loc>https://a.com/1.xml</loc></sitemap>", 1, "index", True),
])
def test_sitemaps(spark, xml, n, status, malformed):
    docs = spark.createDataFrame([("https://a.com/sitemap.xml", xml)], "doc_url string, xml string")
    assert tuple(sitemaps.sitemap_health(docs).first())[1:] == (status, malformed, n)
    sites = spark.createDataFrame([(1, "https://a.com")], "src_ord int, site string")
    got = [r.url for r in sitemaps.sitemap_urls(sites, docs).orderBy("pos").collect()]
    assert got == [f"https://a.com/news/{k}?a=1&b=2" for k in range(1, n + 1)] if status == "ok" else got == []


def test_the_newest_landing_of_a_sitemap_counts(spark):
    rows = [("https://a.com/sitemap.xml", f"<urlset>{loc(k)}</urlset>", f"2025-01-0{k}") for k in (2, 3, 1)]
    docs = spark.createDataFrame(rows, "doc_url string, xml string, landed_at string")
    sites = spark.createDataFrame([(1, "https://a.com")], "src_ord int, site string")
    assert [r.url for r in sitemaps.sitemap_urls(sites, docs).collect()] == ["https://a.com/news/3?a=1&b=2"]
    assert sitemaps.sitemap_urls(sites, docs.drop("landed_at")).count() == 1


@pytest.mark.parametrize("text, want", [
    ("&amp;amp; &amp;eacute; &amp;#38;", "&amp; &eacute; &#38;"), ("x &lt;&amp;gt; y &eacute;", "x <&gt; y \u00e9"),
    ("&&amp;;", "&&;"), ("&amp", "&amp"), ("&AMP; &Lt; &nbsp;&nbsp;", "&AMP; &Lt;   "),  # names of HTML 4 only
])
def test_common_names_are_decoded_once(evaluate, text, want):
    assert evaluate(unescape(F.col("v")), [(text,)]) == [want]
