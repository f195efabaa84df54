"""Inputs of the registered queries, derived from ``documents`` and ``pages``.

SQL texts here run unchanged on Spark and on the checking engine. XML documents
are only built for Spark; the checking SQL works on ``pages`` directly. Every
group that is collected into one document covers a fixed range of page ids, so
no document grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presslens.operators.sentiment import Lexicon
from presslens.sources.feeds import FEED_SUFFIXES
from presslens.sources.tables import spread

TODAY = "2025-01-15"
BATCH_DAY = "2025-01-10"
SCORED_DAY = "2025-01-05"
NOW = "2025-02-01 08:00:00"
DAY_BEFORE = "2025-01-31 08:00:00"

MIN_LEN = 600
MAX_PER_FEED = 3
MAX_PER_SITE = 10
PAGES_PER_FEED = 1000
PAGES_PER_SITE = 5000
PAGE_IDS = 1_000_000_000_000  # added to page ids where they meet document ids

ARTICLES = """
WITH keyed AS (
  SELECT doc_id, text, lang, source,
         CASE WHEN doc_id % 25 = 24 THEN doc_id - 12 ELSE doc_id END AS url_key
  FROM {documents})
SELECT
  doc_id AS id,
  split_part(text, chr(10), 1) AS title,
  'N/A' AS authors,
  CASE WHEN doc_id % 6 = 0 THEN 'N/A' WHEN doc_id % 12 = 1 THEN 'Jan 2, 2025'
       WHEN doc_id % 12 = 7 THEN 'January 2, 2025'
       WHEN doc_id % 12 = 2 THEN 'Thu, 02 Jan 2025 08:00:00 GMT'
       WHEN doc_id % 12 = 8 THEN '2025-01-05T23:30:00.250-05:00'
       WHEN doc_id % 12 = 3 THEN 'soon, 2025'
       ELSE '2025-01-' || lpad(cast(1 + doc_id % 28 AS string), 2, '0') END AS date,
  'N/A' AS summary,
  CASE WHEN doc_id % 11 = 0 THEN 'N/A' ELSE text END AS text,
  'N/A' AS tags,
  'https://' || CASE WHEN url_key % 3 = 0 THEN 'www.' ELSE '' END
    || 'src' || cast(url_key % 20 AS string)
    || '.example.com/news/article-' || cast(url_key AS string) AS url,
  CASE WHEN doc_id % 10 = 0 THEN 'N/A' WHEN doc_id % 10 = 1 THEN ''
       WHEN doc_id % 10 = 2 THEN NULL
       WHEN doc_id % 10 = 3 THEN 'https://www.' || source || '.example.com'
       WHEN doc_id % 10 < 8 THEN 'wire'
       WHEN doc_id % 10 = 8 THEN 'rare ' || cast(doc_id AS string)
       ELSE source END AS source,
  CASE WHEN doc_id % 7 = 0 THEN 'N/A' ELSE lang END AS language,
  CASE WHEN doc_id % 5 < 3 THEN 'layer1' WHEN doc_id % 5 = 3 THEN 'layer2'
       ELSE 'layer3' END AS extracted_by,
  '2025-01-' || lpad(cast(1 + doc_id % 28 AS string), 2, '0') || ' 08:00:00' AS scraped_at
FROM keyed
"""

# Saved before a day; the batch is everything since then, and what was saved
# without a source, which was fetched again.
STORE = f"SELECT * FROM {{articles}} WHERE scraped_at < '{BATCH_DAY}'"
BATCH = f"""
SELECT * FROM {{articles}}
WHERE scraped_at >= '{BATCH_DAY}' OR source IS NULL OR source IN ('', 'N/A')
"""

# Pages with the variety of real sites: mobile hosts without an article element,
# a host without titles, metadata that differs by language.
CRAWL = """
WITH parts AS (
  SELECT page_id, url, html,
         regexp_extract(url, '^https?://([^/?#]+)', 1) AS host,
         regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS lang
  FROM {pages}),
bodies AS (
  SELECT page_id, url, host, lang,
         CASE WHEN host LIKE 'm.%'
              THEN replace(replace(html, '<article>', '<div>'), '</article>', '</div>')
              WHEN host LIKE 'spam%'
              THEN replace(replace(html, '<title>', '<x>'), '</title>', '</x>')
              ELSE html END AS html,
         CASE lang
           WHEN 'en' THEN '<meta name="author" content="Desk ' || host || '">'
             || '<meta content="On &amp; about ' || host || '" name="description">'
             || '<meta name="keywords" content="daily, en">'
           WHEN 'fr' THEN '<meta property="article:author" content="Alice">'
             || '<meta property="article:author" content="Bob">'
             || '<meta property="og:site_name" content="https://www.' || host || '">'
             || '<meta property="article:published_time" content="2025-01-02T23:30:00+05:30">'
             || '<meta property="article:tag" content="un">'
             || '<meta property="article:tag" content="deux">'
           WHEN 'de' THEN '<meta name="date" content="Fri, 03 Jan 2025 10:00:00 +0100">'
             || '<meta property="og:title" content="Titel&#8217;s caf&eacute; &#x2014; &unknown; &amp;amp; ' || host || '">'
             || '<meta property="og:site_name" content="Blatt">'
           WHEN 'es' THEN '<meta name="pubdate" content="January 4, 2025">'
           ELSE '' END AS meta
  FROM parts)
SELECT page_id, url, replace(html, '<head>', '<head>' || meta) AS html, host, lang
FROM bodies
"""

# Front pages: one per landed page, with the feed link written in different ways.
HOMEPAGES = """
SELECT page_id, 'https://' || host || '/p' || cast(page_id AS string) || '/' AS site,
  CASE lang
    WHEN 'en' THEN replace(html, '</head>',
      '<link rel="stylesheet" href="/s.css"><link rel="alternate" type="application/rss+xml" title="x" href="/en/rss.xml"></head>')
    WHEN 'fr' THEN replace(html, '</head>',
      '<LINK href=''https://feeds.example.com/fr'' type=''application/rss+xml'' rel=''alternate''></head>')
    WHEN 'de' THEN replace(html, '</head>',
      '<!-- <link rel="alternate" type="application/rss+xml" href="/off"> --><link rel="alternate" type="application/atom+xml" href="/a"></head>')
    ELSE html END AS html
FROM ({crawl})
"""

# token, valence in tenths
LEXICON = [
    ("idiot", -23), ("stupid", -24), ("eriner", 18), ("trash", -15), ("best", 32),
    ("hewh", 9), ("worthless", -19), ("thanea", 15), ("thnt", -8), ("moron", -22),
    ("attion", 12), ("erst", -11),
]
ENGLISH = ("idiot", "stupid", "trash", "best", "worthless", "moron")
FLIPPED = ("hewh",)

BOOSTERS = [("very", 293000), ("really", 293000), ("the", 293000)]
DAMPERS = [("slightly", -293000), ("barely", -293000), ("and", -293000)]
NEGATORS = ["not", "never", "no", "of"]


def valence_rows() -> list[tuple[str, int]]:
    return [(t, v * 100_000) for t, v in LEXICON]


def polarity_rows() -> list[tuple[str, int, int]]:
    return [
        (t, v * 25_000 * (-1 if t in FLIPPED else 1), 900_000 if t in ENGLISH else 400_000)
        for t, v in LEXICON
    ]


def modifier_rows() -> list[tuple[str, int | None, bool]]:
    return [(t, b, False) for t, b in BOOSTERS + DAMPERS] + [(t, None, True) for t in NEGATORS]


_lexicons: dict[tuple[str, bool], Lexicon] = {}


def lexicon(spark: SparkSession, joined: bool = False) -> Lexicon:
    """The lexicon, read once per session as a job would."""
    key = (spark.sparkContext.applicationId, joined)
    if key not in _lexicons:
        _lexicons[key] = _read_lexicon(spark, joined)
    return _lexicons[key]


def _read_lexicon(spark: SparkSession, joined: bool) -> Lexicon:
    return Lexicon.of(
        spark.createDataFrame(valence_rows(), "token string, valence bigint"),
        spark.createDataFrame(
            polarity_rows(), "token string, polarity bigint, subjectivity bigint"
        ),
        spark.createDataFrame(modifier_rows(), "token string, boost bigint, negates boolean"),
        joined,
    )


def table(spark: SparkSession, sf_dir: str, name: str, costly: bool = False) -> DataFrame:
    """A given table; ``costly`` when the query does much work per row."""
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(scan) if costly else scan


def articles(spark: SparkSession, sf_dir: str, costly: bool = False) -> DataFrame:
    return spark.sql(ARTICLES, documents=table(spark, sf_dir, "documents", costly))


def store(spark: SparkSession, sf_dir: str, costly: bool = False) -> DataFrame:
    return spark.sql(STORE, articles=articles(spark, sf_dir, costly))


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(BATCH, articles=articles(spark, sf_dir))


def pages(spark: SparkSession, sf_dir: str, costly: bool = False) -> DataFrame:
    return table(spark, sf_dir, "pages", costly)


def crawl(spark: SparkSession, sf_dir: str, costly: bool = False) -> DataFrame:
    return spark.sql(CRAWL, pages=pages(spark, sf_dir, costly))


def homepages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(HOMEPAGES.replace("({crawl})", "{crawl}"), crawl=crawl(spark, sf_dir))


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, language and the columns feeds and sitemaps are built from."""
    return pages(spark, sf_dir).select(
        "page_id", "url", "html",
        F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"),
        F.regexp_extract("url", "^https?://[^/]+/([a-z]+)/", 1).alias("lang"),
    )


def _xml(text):
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def _range_of(pages_per_group: int):
    return F.call_function("div", F.col("page_id"), F.lit(pages_per_group).cast("bigint"))


def _joined(order: str, text):
    """Aggregate: texts of a bounded group put together in order."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order), text.alias("x"))))
    return F.array_join(F.transform(rows, lambda r: r["x"]), "")


def feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feed per host and page-id range: Atom for blogs, else RSS; links to a
    page's middle are left out. Each host also has an empty and a broken feed."""
    df = hosts(spark, sf_dir).withColumn("part", _range_of(PAGES_PER_FEED))
    title = _xml(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1))
    no_link = F.col("url").endswith("#top")
    link = _xml(F.col("url"))
    rss = F.concat(
        F.lit("<item><title>"), title, F.lit("</title>"),
        F.when(no_link, F.lit('<guid isPermaLink="false">urn:none</guid>'))
        .when(F.col("page_id") % 4 == 1, F.concat(F.lit("<guid>"), link, F.lit("</guid>")))
        .otherwise(F.concat(F.lit("<link>"), link, F.lit('</link><guid isPermaLink="true">https://x/guid</guid>'))),
        F.lit("</item>"),
    )
    atom = F.concat(
        F.lit("<entry><title>"), title, F.lit('</title><link rel="self" href="https://x/self"/>'),
        F.when(no_link, "").otherwise(
            F.concat(F.lit('<link rel="alternate" href="'), link, F.lit('"/>'))),
        F.lit("</entry>"),
    )
    is_blog = F.col("host").startswith("blog.")
    is_first = F.col("host").startswith("m.")  # RSS 1.0: items beside the channel
    real = (
        df.withColumn("entry_xml", F.when(is_blog, atom).otherwise(rss))
        .groupBy("host", "part")
        .agg(F.min("page_id").alias("src_ord"), _joined("page_id", F.col("entry_xml")).alias("body"))
        .select(
            "src_ord",
            F.concat(F.lit("https://"), "host", F.lit("/feed-"), F.col("part").cast("string")).alias("feed_url"),
            F.when(is_blog, F.concat(
                F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), "body", F.lit("</feed>")))
            .when(is_first, F.concat(
                F.lit('<rdf:RDF xmlns="http://purl.org/rss/1.0/" xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">'
                      "<channel><title>x</title></channel>"), "body", F.lit("</rdf:RDF>")))
            .otherwise(F.concat(
                F.lit('<rss version="2.0"><channel><title>x</title>'), "body",
                F.lit("</channel></rss>")))
            .alias("xml"),
        )
    )
    by_host = df.groupBy("host").agg(F.min("page_id").alias("src_ord"))
    others = by_host.select("src_ord", F.explode(F.array(
        F.struct(
            F.concat(F.lit("https://"), "host", F.lit("/empty")).alias("feed_url"),
            F.lit('<rss version="2.0"><channel><title>x</title></channel></rss>').alias("xml")),
        F.struct(
            F.concat(F.lit("https://"), "host", F.lit("/broken")).alias("feed_url"),
            F.concat(F.lit("<html><body>"), "host", F.lit(" is down")).alias("xml")),
    )).alias("f")).select("src_ord", "f.*")
    return real.unionByName(others)


def site_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One site per host and page-id range; mobile hosts name their sitemap."""
    site = F.concat(F.lit("https://"), "host", F.lit("/s"), F.col("part").cast("string"))
    return (
        hosts(spark, sf_dir).withColumn("part", _range_of(PAGES_PER_SITE))
        .groupBy("host", "part")
        .agg(F.min("page_id").alias("src_ord"))
        .select("src_ord", F.when(
            F.col("host").startswith("m."), F.concat(site, F.lit("/sitemap.xml"))
        ).otherwise(F.concat(site, F.lit("/"))).alias("site"))
    )


def sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site index, one index per language, one document per last digit of the
    page id (up to ten, of which five are read). Digit 0 is one more index, whose
    child at depth 3 must not be read. Documents list pages and their links; those of
    digit 3 are cut off, those of digit 4 hold a bare ampersand. Every document also
    landed the day before, when it was empty."""
    df = hosts(spark, sf_dir).select(
        "page_id", "url", "lang",
        F.concat(F.lit("https://"), "host").alias("base"),
        F.concat(F.lit("https://"), "host", F.lit("/s"),
                 _range_of(PAGES_PER_SITE).cast("string")).alias("root"),
        (F.col("page_id") % 10).cast("string").alias("digit"),
        F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)).alias("links"),
    )
    head = F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">')
    index = F.lit('<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">')

    def child(url):
        return F.concat(F.lit("<sitemap><loc> "), _xml(url), F.lit(" </loc></sitemap>"))

    def loc(url):
        return F.concat(F.lit("<url><loc>"), _xml(url), F.lit("</loc></url>"))

    page = F.concat(
        loc(F.col("url")),
        F.array_join(F.transform("links", lambda h: loc(F.concat("base", h))), ""),
    )
    map_url = F.concat("root", F.lit("/"), "lang", F.lit("/"), "digit")
    sets = df.groupBy("root", "lang", "digit").agg(_joined("page_id", page).alias("body")).select(
        F.concat(map_url, F.when(F.col("digit") == "0", "/deep.xml").otherwise(".xml")).alias("doc_url"),
        F.when(F.col("digit") == "3", F.concat(head, "body", F.lit("<url><loc>https://cut.example.com/off")))
        .when(F.col("digit") == "4", F.concat(head, F.lit("<note>this & that</note>"), "body", F.lit("</urlset>")))
        .otherwise(F.concat(head, "body", F.lit("</urlset>"))).alias("xml"),
    )
    deep = df.where(F.col("digit") == "0").select("root", "lang", "digit").distinct().select(
        F.concat(map_url, F.lit(".xml")).alias("doc_url"),
        F.concat(index, child(F.concat(map_url, F.lit("/deep.xml"))), F.lit("</sitemapindex>")).alias("xml"),
    )
    by_lang = df.select("root", "lang", "digit").distinct().groupBy("root", "lang").agg(
        _joined("digit", child(F.concat(map_url, F.lit(".xml")))).alias("body")
    ).select(
        F.concat("root", F.lit("/"), "lang", F.lit("/sitemap.xml")).alias("doc_url"),
        F.concat(index, "body", F.lit("</sitemapindex>")).alias("xml"),
    )
    root = df.select("root", "lang").distinct().groupBy("root").agg(
        _joined("lang", child(F.concat("root", F.lit("/"), "lang", F.lit("/sitemap.xml")))).alias("body")
    ).select(
        F.concat("root", F.lit("/sitemap.xml")).alias("doc_url"),
        F.concat(index, "body", F.lit("</sitemapindex>")).alias("xml"),
    )
    newest = sets.unionByName(deep).unionByName(by_lang).unionByName(root).withColumn("landed_at", F.lit(NOW))
    older = newest.select("doc_url", F.lit("<urlset></urlset>").alias("xml"), F.lit(DAY_BEFORE).alias("landed_at"))
    return newest.unionByName(older)


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probe log of every host and usual feed path."""
    suffixes = F.array(*[F.lit(s) for s in FEED_SUFFIXES])
    found = (F.length("host") + F.col("ord")) % 4 == 0
    return (
        hosts(spark, sf_dir).select("host").distinct()
        .select("host", F.posexplode(suffixes).alias("ord", "suffix"))
        .select(
            F.concat(F.lit("https://"), "host", "suffix").alias("url"),
            F.when(found, 200).when(F.col("ord") == 0, 200).otherwise(404).alias("status"),
            F.when(found, "application/xml; charset=utf-8").otherwise("text/html").alias("content_type"),
        )
    )


def home_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probe log of the front pages: French and Spanish ones have ``/rss.xml``."""
    return homepages(spark, sf_dir).where(
        F.contains("html", F.lit('<html lang="fr"')) | F.contains("html", F.lit('<html lang="es"'))
    ).where(F.length("site") % 2 == 0).select(
        F.concat(F.regexp_replace("site", "/+$", ""), F.lit("/rss.xml")).alias("url"),
        F.lit(200).alias("status"), F.lit("text/xml").alias("content_type"),
    )
