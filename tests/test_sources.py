from presslens.operators import discover
from presslens.sources import feeds, sitemaps


def feed_table(spark, *docs):
    return spark.createDataFrame(
        [(i, f"f{i}", xml) for i, xml in enumerate(docs)], "src_ord bigint, feed_url string, xml string")


def rss(*links):
    items = "".join("<item><title>t</title>" + (f"<link>{x}</link>" if x else "") + "</item>" for x in links)
    return f'<?xml version="1.0"?><rss version="2.0"><channel><title>c</title>{items}</channel></rss>'


ATOM = """<feed xmlns="http://www.w3.org/2005/Atom">
<entry><link rel="self" href="no"/><link rel="alternate" href="a1"/></entry>
<entry><link href="a2"/></entry><entry><title>x</title></entry></feed>"""


def test_cap_counts_entries_without_link(spark):
    df = feed_table(spark, rss("u1", None, "u3", "u4"), ATOM, rss("a&amp;b"))
    got = feeds.feed_items(df, 3).orderBy("src_ord", "pos").collect()
    assert [(r["feed_url"], r["pos"], r["url"]) for r in got] == [
        ("f0", 0, "u1"), ("f0", 2, "u3"), ("f1", 0, "a1"), ("f1", 1, "a2"), ("f2", 0, "a&b")]


def test_feed_health(spark):
    df = feed_table(spark, rss("u1", None), rss(), "<rss><channel>", "<html><p>down", rss(None))
    got = {r["feed_url"]: (r["status"], r["n_urls"]) for r in feeds.feed_health(df).collect()}
    assert got == {"f0": ("ok", 1), "f1": ("empty", 0), "f2": ("failed", 0),
                   "f3": ("failed", 0), "f4": ("ok", 0)}


def test_entries_of_a_broken_feed_are_used(spark):
    cut_rss = rss("u1", None, "a&amp;b")[:-len("</channel></rss>")] + "<item><link>half"
    cut_atom = ATOM[:-len("</feed>")]
    cdata = "<rss><channel><item><link><![CDATA[u9]]></link></item><item>"
    df = feed_table(spark, cut_rss, cut_atom, cdata)
    got = feeds.feed_items(df, 10).orderBy("src_ord", "pos").collect()
    assert [(r["feed_url"], r["pos"], r["url"]) for r in got] == [
        ("f0", 0, "u1"), ("f0", 2, "a&b"), ("f1", 0, "a1"), ("f1", 1, "a2"), ("f2", 0, "u9")]
    assert {r["status"] for r in feeds.feed_health(df).collect()} == {"ok"}


def test_probe_pick_takes_the_first_suffix(spark):
    sites = spark.createDataFrame([("https://a.com/",), ("https://b.com",)], "site string")
    probes = spark.createDataFrame([
        ("https://a.com/rss.xml", 200, "text/xml"), ("https://a.com/rss", 200, "application/xml"),
        ("https://a.com/feed", 404, "application/xml"), ("https://a.com/feed/", 200, "text/html"),
        ("https://a.com/rss", 200, "application/xml"), ("https://b.com/feed", 500, "text/xml"),
    ], "url string, status int, content_type string")
    got = {r["site"]: r["feed_url"] for r in feeds.probe_pick(sites, probes).collect()}
    assert got == {"https://a.com/": "https://a.com/rss", "https://b.com": None}


def test_feed_link_in_html(spark):
    link = '<link type="application/rss+xml" {} rel="{}">'
    pages = [
        ("<head>" + link.format('href="/rss"', "alternate") + "</head>", "https://a.com/rss"),
        (link.format("href='https://x.com/r?a=1'", "alternate home"), "https://x.com/r?a=1"),
        (link.format("href=rel.xml", "alternate"), "rel.xml"),
        (link.format('href="/no"', "stylesheet"), None),
        ("<!--" + link.format('href="/no"', "alternate") + "-->", None),
        (link.format("", "alternate") + link.format('href="/2"', "alternate"), None),
        ('<link rel="alternate" type="application/atom+xml" href="/atom">', None),
        ("", None),
    ]
    df = spark.createDataFrame([(f"https://a.com/{i}"[:14] + "/", h) for i, (h, _) in enumerate(pages)],
                               "site string, html string")
    got = [r[0] for r in df.selectExpr("html").select(
        feeds.feed_link(df["html"], feeds.F.lit("https://a.com/"))).collect()]
    assert got == [expected for _, expected in pages]


def index(*children):
    inner = "".join(f"<sitemap>{'<loc> ' + c + ' </loc>' if c else '<lastmod>x</lastmod>'}</sitemap>" for c in children)
    return f'<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">{inner}</sitemapindex>'


def urlset(*urls):
    inner = "".join(f"<url><loc>{u}</loc></url>" for u in urls)
    return f'<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">{inner}</urlset>'


def walk(spark, docs, max_urls=30, site="https://a.com"):
    sites = spark.createDataFrame([(0, site)], "src_ord bigint, site string")
    table = spark.createDataFrame(list(docs.items()), "doc_url string, xml string")
    got = sitemaps.sitemap_urls(sites, table, max_urls).orderBy("pos").collect()
    return [r["url"] for r in got]


START = "https://a.com/sitemap.xml"


def test_flat_sitemap_filters_then_caps(spark):
    docs = {START: urlset("https://a.com/", "https://a.com/news/1", "https://a.com/tag/x",
                          "https://a.com/news/2", "https://a.com/news/3")}
    assert walk(spark, docs, 2) == ["https://a.com/news/1", "https://a.com/news/2"]


def test_five_children_in_order_and_a_child_without_url_uses_a_place(spark):
    docs = {START: index("c3", None, "c1", "c2", "c4", "c5")}
    docs.update({f"c{i}": urlset(f"https://a.com/news/{i}") for i in range(1, 6)})
    assert walk(spark, docs) == [f"https://a.com/news/{i}" for i in (3, 1, 2, 4)]


def test_depth_two_is_read_and_three_is_not(spark):
    docs = {START: index("i1", "u1"), "i1": index("i2", "u2"), "i2": index("u3"),
            "u1": urlset("https://a.com/news/one"), "u2": urlset("https://a.com/news/two"),
            "u3": urlset("https://a.com/news/three")}
    assert walk(spark, docs) == ["https://a.com/news/two", "https://a.com/news/one"]
    assert walk(spark, docs, 1) == ["https://a.com/news/two"]


def test_index_ignores_its_own_urls_and_bad_xml_gives_none(spark):
    mixed = index("u1").replace("</sitemapindex>", "<url><loc>https://a.com/news/own</loc></url></sitemapindex>")
    assert walk(spark, {START: mixed, "u1": urlset("https://a.com/news/1")}) == ["https://a.com/news/1"]
    assert walk(spark, {START: "<urlset><url><loc>https://a.com"}) == []


def test_discovery_keeps_feeds_before_sitemaps(spark):
    feed = feed_table(spark, rss("https://a.com/news/2", "https://a.com/x"), rss("https://a.com/x"))
    sites = spark.createDataFrame([(0, "https://a.com")], "src_ord bigint, site string")
    docs = spark.createDataFrame(
        [(START, urlset("https://a.com/news/1", "https://a.com/news/2"))], "doc_url string, xml string")
    parsed = sitemaps.parse_sitemaps(docs, 10)
    got = discover.discover_all(feed, sites, parsed).orderBy(*discover.ORDER).collect()
    assert [r["url"] for r in got] == ["https://a.com/news/2", "https://a.com/x", "https://a.com/news/1"]
    counts = discover.discover_counts(discover.discovered_raw(feed, sites, parsed)).first()
    assert tuple(counts) == (5, 3, 2)


def test_a_large_cap_is_cut_in_two_steps_with_the_same_urls(spark):
    children = [f"https://a.com/s{i}.xml" for i in range(5)]
    docs = {START: index(*children)}
    for i, c in enumerate(children):
        docs[c] = urlset(*[f"https://a.com/news/{i}-{j}" for j in range(900)])
    large = walk(spark, docs, 2500)
    saved = sitemaps.TWO_STEP_FROM
    try:
        sitemaps.TWO_STEP_FROM = 10_000
        assert walk(spark, docs, 2500) == large
    finally:
        sitemaps.TWO_STEP_FROM = saved
    assert len(large) == 2500 and large[0] == "https://a.com/news/0-0" and large[-1] == "https://a.com/news/2-699"
