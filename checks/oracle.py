"""The same queries as SQL over the given tables, for the checking engine."""

from __future__ import annotations

from checks import inputs
from checks.catalog import BOUND, MIN_ARTICLES
from presslens.functions.html import (
    ARTICLE_RE, BLANKS_RE, BODY_RE, BREAK_RE, CHROME_RE,
    HIDDEN_RE, NEWLINES_RE, PARAGRAPH_RE, TAG_RE, TITLE_RE,
)
from presslens.functions.text import SENTENCE_RE, STOPWORDS, WORD_RE
from presslens.functions.urls import HOST_RE, PATH_RE
from presslens.operators.extract import ALL_FAILED
from presslens.sources.feeds import FEED_SUFFIXES


# Written apart from the engine's, as what they are held against.
LETTERS_RE = r"[\p{L}\p{M}]{3,}"
TOKENS_RE = r"[\p{L}\p{M}']+"
ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#8217;", "’"),
    ("&eacute;", "é"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
]


def q(text: str) -> str:
    """A SQL string literal (newlines and tabs as characters)."""
    parts = []
    for piece in text.replace("\\n", "\n").replace("\\t", "\t").replace("\\r", "\r").replace("\\f", "\f").split("\n"):
        parts.append("'" + piece.replace("'", "''") + "'")
    return "(" + " || chr(10) || ".join(parts) + ")"


def values(rows: list[tuple], *columns: str) -> str:
    def lit(x):
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).lower()
        return str(x) if isinstance(x, (int, float)) else q(x)

    body = ", ".join("(" + ", ".join(lit(x) for x in row) + ")" for row in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({', '.join(columns)}))"


def he(num: str, den: str, digits: int) -> str:
    """num / den rounded half-even, on whole numbers."""
    a, n = f"(CAST({num} AS HUGEINT) * {10 ** digits})", f"CAST({den} AS HUGEINT)"
    r = f"((({a} % {n}) + {n}) % {n})"
    whole = f"(({a} - {r}) // {n})"
    up = f"CASE WHEN {r} * 2 > {n} OR ({r} * 2 = {n} AND abs({whole} % 2) = 1) THEN 1 ELSE 0 END"
    return (
        f"CASE WHEN {den} = 0 THEN NULL ELSE CAST({whole} + {up} AS DOUBLE) / {float(10 ** digits)} END"
    )


def pct(part: str, whole: str) -> str:
    return he(f"({part}) * 100", whole, 1)


def label(score: str, bound: float = 0.05) -> str:
    return f"CASE WHEN {score} > {bound} THEN 'positive' WHEN {score} < -{bound} THEN 'negative' ELSE 'neutral' END"


STOP = "(" + ", ".join(q(w) for w in STOPWORDS) + ")"

ARTICLES = inputs.ARTICLES.format(documents="documents")
STORE = inputs.STORE.format(articles=f"({ARTICLES})")
BATCH = inputs.BATCH.format(articles=f"({ARTICLES})")
CRAWL = inputs.CRAWL.format(pages="pages")


def host_of(url: str) -> str:
    return f"lower(concat(regexp_extract({url}, {q(HOST_RE)}, 1), regexp_extract({url}, {q(HOST_RE)}, 2)))"


def domain(url: str) -> str:
    return f"regexp_replace({host_of(url)}, '^www[.]', '')"


def is_article(url: str) -> str:
    path = f"lower(regexp_replace(regexp_extract({url}, {q(PATH_RE)}, 1), ';[^/]*$', ''))"
    skip = [
        "/tag/", "/tags/", "/category/", "/author/", "/page/", "/feed/", "/search/",
        "/?", "/about", "/contact", "/privacy", "/terms",
    ]
    none = " AND ".join(f"NOT contains({path}, {q(s)})" for s in skip)
    return f"(length({path}) >= 5 AND {none})"


BACKFILLED = (
    f"CASE WHEN source IS NULL OR source IN ('', 'N/A') "
    f"THEN coalesce(nullif({domain('url')}, ''), 'N/A') ELSE source END"
)

# Tokens, weights and sums of every article.

SNIPPET = (
    "CASE WHEN text <> '' AND text <> 'N/A' THEN title || '. ' || substring(text, 1, 500) "
    "ELSE title END"
)

SUMS = f"""
articles AS ({ARTICLES}),
lex1 AS {values(inputs.valence_rows(), 'token', 'valence')},
lex2 AS {values(inputs.polarity_rows(), 'token', 'polarity', 'subjectivity')},
modif AS {values(inputs.modifier_rows(), 'token', 'boost', 'negates')},
lists AS (
  SELECT id, regexp_extract_all(lower({SNIPPET}), {q(TOKENS_RE)}) AS words FROM articles),
tokens AS (
  SELECT id, unnest(words) AS token, generate_subscripts(words, 1) AS pos FROM lists),
context AS (
  SELECT t.id, t.token, t.pos,
         lag(m.boost, 1) OVER w AS b1, lag(m.boost, 2) OVER w AS b2, lag(m.boost, 3) OVER w AS b3,
         coalesce(lag(m.negates, 1) OVER w, false) AS n1,
         coalesce(lag(m.negates, 2) OVER w, false) AS n2,
         coalesce(lag(m.negates, 3) OVER w, false) AS n3
  FROM tokens t LEFT JOIN modif m ON t.token = m.token
  WINDOW w AS (PARTITION BY t.id ORDER BY t.pos)),
weighted AS (
  SELECT c.*, l.valence, p.polarity, p.subjectivity,
         CAST(coalesce(l.valence, 0) AS BIGINT) * 100 + sign(coalesce(l.valence, 0))
           * (coalesce(b1, 0) * 100 + coalesce(b2, 0) * 95 + coalesce(b3, 0) * 90) AS plain
  FROM context c LEFT JOIN lex1 l ON c.token = l.token LEFT JOIN lex2 p ON c.token = p.token),
signed AS (
  SELECT *, CAST(CASE WHEN n1 OR n2 OR n3 THEN (plain * -74) // 100 ELSE plain END AS BIGINT) AS v
  FROM weighted),
found AS (
  SELECT id, count(*) AS n_tokens, sum(v) AS total,
         sum(CASE WHEN v > 0 THEN v + 100000000 ELSE 0 END) AS positive,
         sum(CASE WHEN v < 0 THEN 100000000 - v ELSE 0 END) AS negative,
         sum(CASE WHEN v = 0 THEN 100000000 ELSE 0 END) AS unsigned_,
         sum(CASE WHEN n1 THEN -polarity ELSE 2 * polarity END) AS half_polarity,
         sum(subjectivity) AS subjectivity, count(polarity) AS matched
  FROM signed GROUP BY id),
sums AS (
  SELECT a.*, coalesce(total, 0) AS total, coalesce(positive, 0) AS positive,
         coalesce(negative, 0) AS negative, coalesce(unsigned_, 0) AS unsigned_,
         coalesce(half_polarity, 0) AS half_polarity, coalesce(subjectivity, 0) AS subjectivity,
         coalesce(matched, 0) AS matched
  FROM articles a LEFT JOIN found f ON a.id = f.id),
raw AS (
  SELECT *, CASE WHEN total = 0 THEN 0.0 ELSE (CAST(total AS DOUBLE) / 1e8)
       / sqrt((CAST(total AS DOUBLE) / 1e8) * (CAST(total AS DOUBLE) / 1e8) + 15.0) END AS compound,
     positive + negative + unsigned_ AS whole,
     coalesce({he('half_polarity', '(matched * 2000000)', 4)}, 0.0) AS tb_compound
  FROM sums),
scored AS (
  SELECT id, title, text, url, source, date, authors, summary, scraped_at, language,
         CAST(round_even(compound, 4) AS DOUBLE) AS vader_compound, {label('compound')} AS vader_label,
         coalesce({he('positive', 'whole', 4)}, 0.0) AS vader_pos,
         coalesce({he('unsigned_', 'whole', 4)}, 0.0) AS vader_neu,
         coalesce({he('negative', 'whole', 4)}, 0.0) AS vader_neg,
         tb_compound, {label('tb_compound')} AS tb_label,
         coalesce({he('subjectivity', '(matched * 1000000)', 4)}, 0.0) AS tb_subjectivity
  FROM raw)
"""

SCORES = (
    "vader_compound, vader_label, vader_pos, vader_neu, vader_neg, "
    "tb_compound, tb_label, tb_subjectivity"
)

DATE = (
    "CASE WHEN date IN ('Jan 2, 2025', 'January 2, 2025') THEN TIMESTAMP '2025-01-02 00:00:00' "
    "WHEN date LIKE 'Thu, %' THEN TIMESTAMP '2025-01-02 08:00:00' "
    "WHEN date LIKE '%-05:00' THEN TIMESTAMP '2025-01-05 23:30:00' "
    "WHEN date IN ('N/A', 'soon, 2025') THEN NULL ELSE CAST(date AS TIMESTAMP) END"
)

# The analyst's view: sources repaired, sources with enough articles, new labels.

VIEW = f"""
WITH {SUMS},
loaded AS (
  SELECT * REPLACE ({BACKFILLED} AS source, {DATE} AS date) FROM scored),
enough AS (
  SELECT source, count(*) AS n FROM loaded WHERE source <> 'N/A'
  GROUP BY source HAVING count(*) >= {MIN_ARTICLES}),
selected AS (
  SELECT * FROM loaded
  WHERE source IN (SELECT source FROM enough) OR (SELECT count(*) FROM enough) = 0),
viewed AS (
  SELECT * REPLACE ({label('vader_compound', BOUND)} AS vader_label,
                    {label('tb_compound', BOUND)} AS tb_label) FROM selected)
"""


def top(label_name: str, direction: str) -> str:
    return (
        f"{VIEW} SELECT id, title, source, url, date, vader_compound AS score FROM loaded "
        f"WHERE vader_label = '{label_name}' ORDER BY vader_compound {direction}, id LIMIT 10"
    )


# Feeds and sitemaps, straight from the pages.

HOSTS = """
hosts AS (
  SELECT page_id, url, html,
         regexp_extract(url, '^https?://([^/?#]+)', 1) AS host,
         regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS lang
  FROM pages)
"""


def feed_items(cap: int) -> str:
    return f"""
items AS (
  SELECT min(page_id) OVER g AS src_ord,
         'https://' || host || '/feed-' || CAST(page_id // {inputs.PAGES_PER_FEED} AS VARCHAR) AS feed_url,
         CAST(row_number() OVER (PARTITION BY host, page_id // {inputs.PAGES_PER_FEED} ORDER BY page_id) - 1 AS INTEGER) AS pos,
         url, host
  FROM hosts WINDOW g AS (PARTITION BY host, page_id // {inputs.PAGES_PER_FEED})),
feed AS (
  SELECT src_ord, feed_url, pos, url FROM items WHERE pos < {cap} AND NOT suffix(url, '#top'))
"""


SITE = f"""
sites AS (
  SELECT host, page_id // {inputs.PAGES_PER_SITE} AS part, min(page_id) AS src_ord,
         CASE WHEN starts_with(host, 'm.')
              THEN 'https://' || host || '/s' || CAST(page_id // {inputs.PAGES_PER_SITE} AS VARCHAR) || '/sitemap.xml'
              ELSE 'https://' || host || '/s' || CAST(page_id // {inputs.PAGES_PER_SITE} AS VARCHAR) || '/' END AS site
  FROM hosts GROUP BY host, page_id // {inputs.PAGES_PER_SITE})
"""

SITEMAP = f"""
{SITE},
ranked AS (
  SELECT host, page_id // {inputs.PAGES_PER_SITE} AS part, page_id, lang, page_id % 10 AS digit,
         dense_rank() OVER (PARTITION BY host, page_id // {inputs.PAGES_PER_SITE} ORDER BY lang) AS lang_rank,
         dense_rank() OVER (PARTITION BY host, page_id // {inputs.PAGES_PER_SITE}, lang ORDER BY page_id % 10) AS digit_rank,
         list_concat([url], list_transform(regexp_extract_all(html, '<a href="([^"]*)"', 1),
                     lambda h: 'https://' || host || h)) AS links
  FROM hosts),
links AS (
  SELECT host, part, page_id, lang, digit, unnest(links) AS url, generate_subscripts(links, 1) AS i
  FROM ranked WHERE lang_rank <= 5 AND digit_rank <= 5 AND digit <> 0),
numbered AS (
  SELECT l.*, row_number() OVER (PARTITION BY host, part ORDER BY lang, digit, page_id, i) AS rn
  FROM links l WHERE {is_article('trim(url)')}),
mapped AS (
  SELECT s.src_ord, s.site, CAST(rn - 1 AS INTEGER) AS pos, trim(url) AS url
  FROM numbered n JOIN sites s ON n.host = s.host AND n.part = s.part
  WHERE rn <= {inputs.MAX_PER_SITE})
"""

RAW = f"""
WITH {HOSTS}, {feed_items(inputs.MAX_PER_SITE)}, {SITEMAP},
found AS (
  SELECT 1 AS kind, src_ord, feed_url AS source_url, pos, url FROM feed
  UNION ALL SELECT 2, src_ord, site, pos, url FROM mapped),
discovered AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY url ORDER BY kind, src_ord, source_url, pos) AS rn
    FROM found) WHERE rn = 1)
"""

# Extraction.


def replaced(text: str, pattern: str, by: str) -> str:
    return f"regexp_replace({text}, {q(pattern)}, {q(by)}, 'g')"


def unescaped(text: str) -> str:
    for entity, char in ENTITIES:
        text = f"replace({text}, {q(entity)}, {q(char)})"
    return text


EDGES_RE = "^[ \\n]+|[ \\n]+$"


def plain(html: str) -> str:
    text = unescaped(replaced(replaced(html, BREAK_RE, "\n"), TAG_RE, ""))
    return replaced(replaced(replaced(text, BLANKS_RE, " "), NEWLINES_RE, "\n"), EDGES_RE, "")


def keyword_tables(source: str, key: str) -> str:
    """CTEs ``kw`` and ``summaries`` of a relation ``source(key, text)``."""
    return f"""
kw_words AS (
  SELECT {key}, unnest(regexp_extract_all(lower(text), {q(LETTERS_RE)})) AS term FROM {source}),
kw AS (
  SELECT {key}, term, n, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, term) AS rank
  FROM (SELECT {key}, term, count(*) AS n FROM kw_words WHERE term NOT IN {STOP} GROUP BY {key}, term)
  QUALIFY rank <= 10),
sent_lists AS (
  SELECT {key}, list_filter(list_transform(regexp_extract_all(text, {q(SENTENCE_RE)}), lambda s: trim(s)),
                            lambda s: s <> '') AS parts FROM {source}),
sentences AS (
  SELECT {key}, unnest(parts) AS s, generate_subscripts(parts, 1) AS i FROM sent_lists),
sent_words AS (
  SELECT {key}, i, unnest(regexp_extract_all(lower(s), {q(LETTERS_RE)})) AS term FROM sentences),
sent_scores AS (
  SELECT w.{key}, w.i, sum(k.n) AS score
  FROM sent_words w JOIN kw k ON w.{key} = k.{key} AND w.term = k.term GROUP BY w.{key}, w.i),
best AS (
  SELECT s.{key}, s.i, s.s,
         row_number() OVER (PARTITION BY s.{key} ORDER BY coalesce(c.score, 0) DESC, s.i) AS rank
  FROM sentences s LEFT JOIN sent_scores c ON s.{key} = c.{key} AND s.i = c.i
  QUALIFY rank <= 5),
kw_lists AS (
  SELECT d.{key}, coalesce(nullif(string_agg(k.term, ', ' ORDER BY k.rank), ''), 'N/A') AS keywords
  FROM {source} d LEFT JOIN kw k ON d.{key} = k.{key} GROUP BY d.{key}),
summaries AS (
  SELECT d.{key}, coalesce(nullif(string_agg(b.s, ' ' ORDER BY b.i), ''), 'N/A') AS summary
  FROM {source} d LEFT JOIN best b ON d.{key} = b.{key} GROUP BY d.{key})
"""


META = {
    "authors": "CASE lang WHEN 'en' THEN 'Desk ' || host WHEN 'fr' THEN 'Alice, Bob' ELSE 'N/A' END",
    "date": "CASE lang WHEN 'fr' THEN '2025-01-02' WHEN 'de' THEN '2025-01-03' WHEN 'es' THEN '2025-01-04' ELSE 'N/A' END",
    "description": "CASE lang WHEN 'en' THEN 'On & about ' || host ELSE 'N/A' END",
    "keywords": "CASE lang WHEN 'en' THEN 'daily, en' ELSE 'N/A' END",
    "tags": "CASE lang WHEN 'fr' THEN 'un, deux' ELSE 'N/A' END",
    "site": f"CASE lang WHEN 'fr' THEN {domain(chr(39) + 'https://www.' + chr(39) + ' || host')} WHEN 'de' THEN 'Blatt' ELSE {domain('url')} END",
}

PARTS = f"""
crawl AS ({CRAWL}),
seen AS (
  SELECT page_id, url, host, lang, {replaced('html', HIDDEN_RE, ' ')} AS visible,
         CASE WHEN lang = 'de' THEN 'Titel’s café — &unknown; &amp; ' || host
              ELSE nullif({plain(f"regexp_extract(split_part(html, '</head>', 1), {q(TITLE_RE)}, 1)")}, '') END AS title,
         lower(regexp_extract(split_part(html, '</head>', 1), '<html lang="([a-zA-Z-]+)', 1)) AS page_lang
  FROM crawl),
texts AS (
  SELECT *, {plain(replaced(f"regexp_extract(visible, {q(ARTICLE_RE)}, 1)", CHROME_RE, " "))} AS text1,
         array_to_string(list_filter(list_transform(
             regexp_extract_all(visible, {q(PARAGRAPH_RE)}, 1), lambda p: {plain('p')}),
             lambda p: p <> ''), chr(10)) AS text2,
         {plain(f"regexp_extract(visible, {q(BODY_RE)}, 1)")} AS text3
  FROM seen),
sources2 AS (SELECT page_id, text2 AS text FROM texts),
{keyword_tables('sources2', 'page_id')},
candidates AS (
  SELECT t.*, length(text1) >= {inputs.MIN_LEN} AS ok1,
         length(text2) >= {inputs.MIN_LEN} AND title IS NOT NULL AS ok2,
         length(text3) >= {inputs.MIN_LEN} AND title IS NOT NULL AS ok3,
         k.keywords, s.summary
  FROM texts t JOIN kw_lists k ON t.page_id = k.page_id JOIN summaries s ON t.page_id = s.page_id),
layer1 AS (
  SELECT page_id, coalesce(title, 'N/A') AS title, {META['authors']} AS authors, {META['date']} AS date,
         {META['description']} AS summary, text1 AS text, {META['keywords']} AS tags, url,
         {META['site']} AS source, coalesce(nullif(page_lang, ''), 'N/A') AS language,
         'layer1' AS extracted_by, '{inputs.NOW}' AS scraped_at FROM candidates WHERE ok1),
layer2 AS (
  SELECT page_id, title, {META['authors']} AS authors, {META['date']} AS date,
         summary, text2 AS text, keywords AS tags, url, {domain('url')} AS source, 'N/A' AS language,
         'layer2' AS extracted_by, '{inputs.NOW}' AS scraped_at FROM candidates WHERE ok2),
layer3 AS (
  SELECT page_id, title, {META['authors']} AS authors, {META['date']} AS date,
         {META['description']} AS summary, text3 AS text, {META['tags']} AS tags, url,
         {domain('url')} AS source, coalesce(nullif(page_lang, ''), 'N/A') AS language,
         'layer3' AS extracted_by, '{inputs.NOW}' AS scraped_at FROM candidates WHERE ok3),
extracted AS (
  SELECT page_id AS id, * EXCLUDE (page_id) FROM (
    SELECT * FROM layer1
    UNION ALL SELECT * FROM layer2 WHERE page_id NOT IN (SELECT page_id FROM layer1)
    UNION ALL SELECT * FROM layer3 WHERE page_id NOT IN (SELECT page_id FROM layer1)
                                     AND page_id NOT IN (SELECT page_id FROM layer2))),
failed AS (SELECT page_id, url FROM crawl WHERE page_id NOT IN (SELECT id FROM extracted))
"""

NEW = f"""
WITH batch AS (SELECT * REPLACE (CASE WHEN id % 41 <> 0 THEN url END AS url) FROM ({BATCH})), store AS ({STORE}),
fresh AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY url ORDER BY id) AS rn FROM batch)
  WHERE (rn = 1 AND url NOT IN (SELECT url FROM store)) OR url IS NULL)
"""

PROBED = """
probed AS (
  SELECT 'https://' || host || '/' AS site, 'https://' || host || suffix AS feed_url, ord,
         (length(host) + ord) % 4 = 0 AS hit
  FROM (SELECT DISTINCT host FROM hosts) h CROSS JOIN suffixes)
"""

HOME = f"""
home AS (
  SELECT 'https://' || host || '/p' || CAST(page_id AS VARCHAR) AS base, page_id, host, lang, html
  FROM ({CRAWL})),
linked AS (
  SELECT base || '/' AS site, base,
         CASE lang WHEN 'en' THEN base || '/en/rss.xml' WHEN 'fr' THEN 'https://feeds.example.com/fr' END AS from_html,
         CASE WHEN (html LIKE '%<html lang="fr"%' OR html LIKE '%<html lang="es"%')
               AND length(base || '/') % 2 = 0 THEN base || '/rss.xml' END AS from_probe
  FROM home)
"""

SUFFIX_ROWS = values(list(enumerate(FEED_SUFFIXES)), "ord", "suffix")

RETENTION_LIMIT = 100


def _retention() -> str:
    """Appends replayed one line at a time by a recursive query over two counts."""
    half = RETENTION_LIMIT // 2
    return f"""
WITH RECURSIVE log AS (
  SELECT url, CASE WHEN regexp_matches(url, '^https?://m[.]') THEN '{inputs.NOW}'
                   ELSE '{inputs.DAY_BEFORE}' END AS failed_at FROM pages),
counts AS (
  SELECT count(*) FILTER (WHERE failed_at < '{inputs.NOW}') AS old,
         count(*) FILTER (WHERE failed_at = '{inputs.NOW}') AS new FROM log),
steps AS (
  SELECT old AS lines, new AS todo, false AS rotated FROM counts
  UNION ALL
  SELECT CASE WHEN lines >= {RETENTION_LIMIT} THEN lines - {half} + 2 ELSE lines + 1 END, todo - 1,
         rotated OR lines >= {RETENTION_LIMIT}
  FROM steps WHERE todo > 0),
final AS (SELECT lines, rotated FROM steps WHERE todo = 0),
numbered AS (
  SELECT url, failed_at, row_number() OVER (ORDER BY failed_at DESC, url DESC) AS age FROM log)
SELECT failed_at, '{ALL_FAILED}' AS reason, url FROM numbered, final
WHERE age <= lines - CASE WHEN rotated THEN 1 ELSE 0 END
UNION ALL
SELECT '{inputs.NOW}', '--- log rotated ---', NULL FROM final WHERE rotated
"""


EXTRACTED_COLUMNS = (
    "title, authors, date, summary, text, tags, url, source, language, extracted_by, scraped_at"
)

ORACLE = {
    "feed_items": f"WITH {HOSTS}, {feed_items(inputs.MAX_PER_FEED)} SELECT src_ord, feed_url, pos, url FROM feed",
    "feed_health": f"""
WITH {HOSTS}, {feed_items(inputs.MAX_PER_FEED)}
SELECT feed_url, 'ok' AS status,
       count(*) FILTER (WHERE pos < {inputs.MAX_PER_FEED} AND NOT suffix(url, '#top')) AS n_urls
FROM items GROUP BY feed_url
UNION ALL SELECT DISTINCT 'https://' || host || '/empty', 'empty', 0 FROM hosts
UNION ALL SELECT DISTINCT 'https://' || host || '/broken', 'failed', 0 FROM hosts""",
    "sitemap_urls": f"WITH {HOSTS}, {SITEMAP} SELECT src_ord, site, pos, url FROM mapped",
    "sitemap_health": f"""
WITH {HOSTS}, docs AS (
  SELECT 'https://' || host || '/s' || CAST(page_id // {inputs.PAGES_PER_SITE} AS VARCHAR) AS root, lang, page_id % 10 AS digit,
         1 + len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS links FROM hosts),
landed AS (
  SELECT root || '/' || lang || '/' || CASE WHEN digit = 0 THEN '0/deep' ELSE CAST(digit AS VARCHAR) END || '.xml' AS doc_url,
         'ok' AS status, digit IN (3, 4) AS malformed, CAST(sum(links) AS BIGINT) AS n_locs FROM docs GROUP BY root, lang, digit
  UNION ALL SELECT DISTINCT root || '/' || lang || '/0.xml', 'index', false, 1 FROM docs WHERE digit = 0
  UNION ALL SELECT root || '/' || lang || '/sitemap.xml', 'index', false, count(DISTINCT digit) FROM docs GROUP BY root, lang
  UNION ALL SELECT root || '/sitemap.xml', 'index', false, count(DISTINCT lang) FROM docs GROUP BY root)
SELECT * FROM landed UNION ALL SELECT doc_url, 'empty', false, 0 FROM landed""",
    "sitemap_guess": f"""
WITH {HOSTS}, {SITE}
SELECT site, CASE WHEN suffix(site, '.xml') THEN site ELSE rtrim(site, '/') || '/sitemap.xml' END AS sitemap
FROM sites""",
    "feed_probe_pick": f"""
WITH {HOSTS}, suffixes AS {SUFFIX_ROWS}, {PROBED}
SELECT site, arg_min(feed_url, ord) FILTER (WHERE hit) AS feed_url FROM probed GROUP BY site""",
    "feed_link_html": f"WITH {HOME} SELECT site, from_html AS feed_url FROM linked",
    "find_feeds": f"""
WITH {HOME} SELECT site, from_probe, from_html, coalesce(from_probe, from_html) AS feed_url FROM linked""",
    "discover_all": f"{RAW} SELECT kind, src_ord, source_url, pos, url FROM discovered",
    "discover_counts": f"""
{RAW} SELECT (SELECT count(*) FROM found) AS raw_urls, (SELECT count(*) FROM discovered) AS unique_urls,
(SELECT count(*) FROM found) - (SELECT count(*) FROM discovered) AS duplicate_urls""",
    "dedupe_keep_first": f"SELECT min(id) AS pos, url FROM ({ARTICLES}) GROUP BY url",
    "load_articles": f"""
WITH {SUMS} SELECT id, title, url, coalesce(source, 'N/A') AS source, {DATE} AS date, authors, summary,
scraped_at, {SCORES} FROM scored ORDER BY scraped_at DESC, id""",
    "extract_layer1": f"WITH {PARTS} SELECT page_id, {EXTRACTED_COLUMNS} FROM layer1",
    "extract_layer2": f"WITH {PARTS} SELECT page_id, {EXTRACTED_COLUMNS} FROM layer2",
    "extract_layer3": f"WITH {PARTS} SELECT page_id, {EXTRACTED_COLUMNS} FROM layer3",
    "extract_articles": f"WITH {PARTS} SELECT id, {EXTRACTED_COLUMNS} FROM extracted",
    "extract_counts": f"""
WITH {PARTS} SELECT (SELECT count(*) FROM crawl) AS tried, (SELECT count(*) FROM extracted) AS scraped,
(SELECT count(*) FROM failed) AS failed""",
    "doc_keywords": f"WITH {keyword_tables('documents', 'doc_id')} SELECT doc_id, keywords FROM kw_lists",
    "doc_summary": f"WITH {keyword_tables('documents', 'doc_id')} SELECT doc_id, summary FROM summaries",
    "insert_new": f"{NEW} SELECT * FROM fresh",
    "insert_counts": f"""
{NEW} SELECT (SELECT count(*) FROM fresh) AS inserted,
(SELECT count(*) FROM batch) - (SELECT count(*) FROM fresh) AS duplicates""",
    "score_unscored": f"WITH {SUMS} SELECT id, {SCORES} FROM scored WHERE scraped_at < '{inputs.BATCH_DAY}'",
    "backfill_sources": f"SELECT id, {BACKFILLED} AS source FROM ({ARTICLES})",
    "repaired_store": f"""
WITH a AS ({ARTICLES}),
kept AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY id) AS rn FROM a)
  WHERE rn = 1 OR url IS NULL),
fixed AS (SELECT id, source AS before, {BACKFILLED} AS source FROM kept)
SELECT id, source, (SELECT count(*) FROM fixed WHERE source IS DISTINCT FROM before) AS changed_first,
       CAST(0 AS BIGINT) AS changed_second
FROM fixed""",
    "store_table": f"""
WITH a AS ({ARTICLES})
SELECT id, url, source, CAST(0 AS BIGINT) AS ingest_batch FROM (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY id) AS rn FROM a)
WHERE rn = 1 OR url IS NULL""",
    "backfill_count": f"SELECT count(*) AS updated FROM ({ARTICLES}) WHERE source IS NULL OR source IN ('', 'N/A')",
    "ensure_columns": f"""
SELECT id, title, CAST(NULL AS DOUBLE) AS vader_compound, CASE WHEN id % 2 = 0 THEN 'neutral' END AS vader_label,
CAST(NULL AS DOUBLE) AS vader_pos, CAST(NULL AS DOUBLE) AS vader_neu, CAST(NULL AS DOUBLE) AS vader_neg,
CAST(NULL AS DOUBLE) AS tb_compound, CAST(NULL AS VARCHAR) AS tb_label,
CAST(NULL AS DOUBLE) AS tb_subjectivity FROM ({ARTICLES})""",
    "csv_roundtrip": f"SELECT * EXCLUDE (id) REPLACE (coalesce(source, '') AS source) FROM ({ARTICLES})",
    "dead_letters": f"""
WITH {PARTS} SELECT '{inputs.NOW}' AS failed_at, '{ALL_FAILED}' AS reason, url FROM failed""",
    "dead_letter_retention": _retention(),
    "article_urls": f"""
WITH {HOSTS}, lists AS (
  SELECT page_id, list_concat([url], list_transform(regexp_extract_all(html, '<a href="([^"]*)"', 1),
         lambda h: 'https://' || host || h)) AS links FROM hosts),
links AS (SELECT page_id, CAST(generate_subscripts(links, 1) - 1 AS INTEGER) AS pos, unnest(links) AS url FROM lists)
SELECT page_id, pos, url, {is_article('url')} AS is_article FROM links""",
    "url_domain": f"SELECT page_id, {domain('url')} AS domain FROM pages",
    "clean_source": f"""
SELECT id, CASE WHEN source IS NULL OR source IN ('', 'N/A') THEN {domain('url')}
WHEN starts_with(source, 'http') THEN {domain('source')} ELSE source END AS source FROM ({ARTICLES})""",
    "title_tokens": f"""
SELECT id, coalesce(array_to_string(list_filter(regexp_extract_all(lower(title), {q(WORD_RE)}),
lambda w: w NOT IN {STOP}), ' '), '') AS tokens FROM ({ARTICLES})""",
    "snippet": f"SELECT id, {SNIPPET} AS snippet FROM ({ARTICLES})",
    "parse_dates": f"SELECT id, {DATE} AS date FROM ({ARTICLES})",
    "join_authors": f"""
SELECT id, coalesce(nullif(array_to_string(regexp_extract_all(title, '[A-Z][a-z]+'), ', '), ''), 'N/A') AS authors
FROM ({ARTICLES})""",
    "score_compound": f"WITH {SUMS} SELECT id, vader_compound, vader_label, vader_pos, vader_neu, vader_neg FROM scored",
    "score_polarity": f"WITH {SUMS} SELECT id, tb_compound, tb_label, tb_subjectivity FROM scored",
    "score_articles": f"WITH {SUMS} SELECT id, {SCORES} FROM scored",
    "score_articles_joined": f"WITH {SUMS} SELECT id, {SCORES} FROM scored",
    "kpi_strip": f"""
{VIEW} SELECT count(*) AS articles, count(DISTINCT source) AS sources,
{pct("count(*) FILTER (WHERE vader_label = 'positive')", "count(*)")} AS positive_pct,
{pct("count(*) FILTER (WHERE vader_label = 'negative')", "count(*)")} AS negative_pct,
coalesce({pct("count(*) FILTER (WHERE vader_label = tb_label)", "count(*)")}, 0.0) AS agreement_pct FROM viewed""",
    "agreement_rate": f"""
{VIEW} SELECT coalesce({pct("count(*) FILTER (WHERE vader_label = tb_label)", "count(*)")}, 0.0) AS agreement_pct FROM loaded""",
    "label_distribution": f"""
{VIEW}, labels AS (
  SELECT 'vader' AS scorer, vader_label AS label FROM viewed
  UNION ALL SELECT 'textblob', tb_label FROM viewed),
counted AS (SELECT scorer, label, count(*) AS n FROM labels GROUP BY scorer, label)
SELECT scorer, label, n, {pct('n', '(SELECT count(*) FROM viewed)')} AS share_pct FROM counted""",
    "relabel": f"""
WITH {SUMS} SELECT id, vader_compound, {label('vader_compound', BOUND)} AS vader_label, tb_compound,
{label('tb_compound', BOUND)} AS tb_label FROM scored""",
    "eligible_sources": f"{VIEW} SELECT source, n FROM enough ORDER BY source",
    "filter_sources": f"{VIEW} SELECT id, source FROM selected",
    "filter_selected": f"""
{VIEW} SELECT id, source FROM loaded WHERE source IN ('wire', 'src1.example.com', 'nobody')""",
    "filter_unselected": f"{VIEW} SELECT id, source FROM loaded",
    "sentiment_by_source": f"""
{VIEW}, means AS (
  SELECT source,
    {he('sum(CAST(round(vader_compound * 10000) AS BIGINT))', '(count(*) * 10000)', 3)} AS vader_mean,
    {he('sum(CAST(round(tb_compound * 10000) AS BIGINT))', '(count(*) * 10000)', 3)} AS tb_mean
  FROM loaded GROUP BY source)
SELECT source, vader_mean, tb_mean, {label('vader_mean')} AS bar_label FROM means ORDER BY vader_mean, source""",
    "top_positive": top("positive", "DESC"),
    "top_negative": top("negative", "ASC"),
    "top_headlines_both": f"""
{VIEW} SELECT label, id, title, source, url, date, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT tb_label AS label, id, title, source, url, date, tb_compound AS score,
         row_number() OVER (PARTITION BY tb_label ORDER BY
           CASE WHEN tb_label = 'negative' THEN tb_compound ELSE -tb_compound END, id) AS rank
  FROM loaded) WHERE rank <= 10""",
    "term_frequency": f"""
{VIEW}, words AS (
  SELECT unnest(regexp_extract_all(lower(title), {q(WORD_RE)})) AS term FROM loaded WHERE vader_label = 'negative'),
counted AS (SELECT term, count(*) AS n FROM words WHERE term NOT IN {STOP} GROUP BY term)
SELECT term, n, n / CAST((SELECT max(n) FROM counted) AS DOUBLE) AS weight
FROM counted ORDER BY n DESC, term LIMIT 70""",
    "word_text_by_source": f"""
{VIEW}, rows_ AS (
  SELECT source, id // 1000 AS part, id, array_to_string(list_filter(
      regexp_extract_all(lower(title), {q(WORD_RE)}), lambda w: w NOT IN {STOP}), ' ') AS words
  FROM loaded WHERE vader_label = 'positive')
SELECT source, part, count(*) AS titles, string_agg(words, ' ' ORDER BY id) AS words
FROM rows_ WHERE words <> '' GROUP BY source, part""",
    "raw_scored": f"""
{VIEW} SELECT id, title, source, date, vader_compound, vader_label, tb_compound, tb_label, tb_subjectivity
FROM loaded ORDER BY vader_compound, id""",
    "scorer_scatter": f"{VIEW} SELECT id, title, source, vader_compound, tb_compound, vader_label AS label FROM loaded",
    "scorer_scatter_bins": f"""
{VIEW} SELECT CAST(least(floor((vader_compound + 1) * 10), 19) AS BIGINT) AS vader_bin,
CAST(least(floor((tb_compound + 1) * 10), 19) AS BIGINT) AS tb_bin, vader_label AS label, count(*) AS n
FROM loaded GROUP BY ALL""",
    "score_badge": f"""
WITH {SUMS} SELECT id, CASE WHEN vader_compound > 0.05 THEN 'score-pos' WHEN vader_compound < -0.05
THEN 'score-neg' ELSE 'score-neu' END AS badge_class,
CASE WHEN vader_compound > 0.05 THEN '+' ELSE '' END || printf('%.3f', vader_compound) AS badge_text
FROM scored""",
    "db_stats": f"""
SELECT count(*) AS total_articles,
count(*) FILTER (WHERE starts_with(scraped_at, '{inputs.TODAY}')) AS articles_today FROM ({ARTICLES})""",
    "store_size_text": f"""
SELECT language, format('{{:,}}', CAST(sum(length(text)) AS BIGINT)) AS characters FROM ({ARTICLES}) GROUP BY language""",
    "is_empty_store": f"""
SELECT 'new' AS store, true AS empty
UNION ALL SELECT 'filled', (SELECT count(*) = 0 FROM ({ARTICLES}))""",
    "top_sources": f"""
SELECT source, count(*) AS n FROM ({ARTICLES}) WHERE source <> 'N/A' GROUP BY source ORDER BY n DESC, source LIMIT 5""",
    "top_languages": f"""
SELECT language, count(*) AS n FROM ({ARTICLES}) WHERE language <> 'N/A' GROUP BY language ORDER BY n DESC, language LIMIT 5""",
    "source_bars": f"""
SELECT source, count(*) AS n, repeat('█', CAST(least(count(*), 20) AS INTEGER)) AS bar
FROM ({ARTICLES}) WHERE source <> 'N/A' GROUP BY source ORDER BY n DESC, source LIMIT 5""",
    "extractor_breakdown": f"""
WITH {PARTS} SELECT extracted_by, count(*) AS n
FROM extracted GROUP BY extracted_by ORDER BY n DESC, extracted_by""",
    "preview": f"""
WITH {PARTS} SELECT id, title, source, authors, date, language, substring(tags, 1, 80) AS tags, extracted_by,
substring(summary, 1, 100) || CASE WHEN length(summary) > 100 THEN '...' ELSE '' END AS summary
FROM extracted ORDER BY id LIMIT 5""",
    "run_summary": f"""
{RAW}, {PARTS},
counts AS (
  SELECT (SELECT count(*) FROM discovered) AS urls,
    (SELECT count(*) FROM extracted WHERE url IN (SELECT url FROM discovered)) AS scraped,
    (SELECT count(*) FROM extracted WHERE url IN (SELECT url FROM discovered)
       AND url NOT IN (SELECT url FROM crawl WHERE starts_with(host, 'blog.'))) AS fresh)
SELECT urls AS urls_discovered, scraped, fresh AS new_in_store, scraped - fresh AS duplicates,
urls - scraped AS failed, {pct('scraped', 'urls')} AS success_pct FROM counts""",
    "stream_dead_letters": f"""
WITH {PARTS} SELECT '{inputs.NOW}' AS failed_at, '{ALL_FAILED}' AS reason, url FROM (
  SELECT url FROM failed UNION ALL SELECT url FROM failed WHERE regexp_matches(url, '^https?://blog[.]'))""",
    "mixed_writers": f"""
WITH {PARTS}, saved AS ({STORE})
SELECT id, url, CAST(1 AS BIGINT) AS n_scores FROM (
  SELECT min(id) AS id, url FROM saved GROUP BY url
  UNION ALL SELECT id + {inputs.PAGE_IDS}, url FROM extracted)""",
    "scheduled_run": f"""
{RAW}, {PARTS}
SELECT id, title, url, '{inputs.NOW}' AS created_at, true AS scored FROM extracted
WHERE url IN (SELECT url FROM discovered)""",
    "scheduled_letters": f"""
{RAW}, {PARTS}
SELECT '{inputs.NOW}' AS failed_at, '{ALL_FAILED}' AS reason, url FROM discovered
WHERE url NOT IN (SELECT url FROM extracted)""",
    "stream_ingest": f"WITH {PARTS} SELECT id, {EXTRACTED_COLUMNS} FROM extracted",
    "stream_score": f"""
WITH {SUMS}, kept AS (
  SELECT id FROM (
    SELECT id, row_number() OVER (PARTITION BY url ORDER BY scraped_at >= '{inputs.BATCH_DAY}', id) AS rn FROM articles)
  WHERE rn = 1)
SELECT id, {SCORES} FROM scored WHERE id IN (SELECT id FROM kept)""",
}
