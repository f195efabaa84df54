"""HTML to text and metadata with regular expressions only.

No pattern has look-around or nested repeats, and all read the same in other regex
engines. Unclosed comments, scripts, styles and bodies end with the page; many
unclosed articles or paragraphs each cost a look to the end of it.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from presslens.functions.text import all_matches, let, or_null

HIDDEN_RE = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script>|\z)|<style\b.*?(?:</style>|\z)"
CHROME_RE = r"(?is)<(?:nav\b.*?</nav>|header\b.*?</header>|footer\b.*?</footer>|aside\b.*?</aside>)"
BREAK_RE = r"(?i)<(?:/p|br|/h[1-6]|/li|/div)\b[^>]*>"
TAG_RE = r"<[^>]*>"
BLANKS_RE = "[ \\t\\r\\f]{2,}|[\\t\\r\\f]"
NEWLINES_RE = " ?\\n[ \\n]*"
ARTICLE_RE = r"(?is)<article\b[^>]*>(.*?)</article>"
PARAGRAPH_RE = r"(?is)<p\b[^>]*>(.*?)</p>"
BODY_RE = r"(?is)<body\b[^>]*>(.*?)(?:</body>|\z)"
TITLE_RE = r"(?is)<title\b[^>]*>(.*?)</title>"
HEADING_RE = r"(?is)<h1\b[^>]*>(.*?)</h1>"
LANG_RE = r"""(?is)<html\b[^>]*\slang\s*=\s*["']?([a-zA-Z-]+)"""
TIME_RE = r"""(?is)<time\b[^>]*\sdatetime\s*=\s*["']?([^"'\s>]+)"""
META_RE = r"(?is)<meta\b[^>]*>"
NAME_RE = r"""(?is)\s(?:name|property)\s*=\s*["']?([^"'\s>]+)"""
CONTENT_RE = r"""(?is)\scontent\s*=\s*(?:"([^"]*)"|'([^']*)')"""

REFERENCE_RE = "&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"

# The named references of HTML 4 and the apostrophe; a no-break space reads as a blank.
NAMED = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'", "nbsp": " "}


def _named() -> Column:
    return F.create_map(*[F.lit(x) for pair in sorted(NAMED.items()) for x in pair])


def _referred(name: Column) -> Column:
    """The character of a reference's name; the reference itself if there is none."""
    code = F.when(
        name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 6), 16, 10)
    ).when(name.startswith("#"), F.substring(name, 2, 7)).cast("bigint")
    valid = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
    point = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.coalesce(
        F.when(name.startswith("#"), F.when(code == 160, " ").when(valid, point)).otherwise(F.try_element_at(_named(), name)),
        F.concat(F.lit("&"), name, F.lit(";")),
    )


def unescape(text: Column) -> Column:
    """Character references decoded, once: named ones of HTML 4, decimal and hexadecimal ones."""

    def decoded(t: Column) -> Column:
        parts = F.struct(
            F.split(t, REFERENCE_RE, -1).alias("plain"),
            F.transform(all_matches(t, REFERENCE_RE, 1), _referred).alias("chars"),
        )
        return let(parts, lambda p: F.array_join(F.transform(
            p["plain"], lambda s, i: F.concat(s, F.coalesce(F.get(p["chars"], i), F.lit("")))), ""))

    return let(text, lambda t: F.when(F.contains(t, F.lit("&")), decoded(t)).otherwise(t))


def visible(html: Column) -> Column:
    """The page without comments, scripts and styles."""
    return F.regexp_replace(html, HIDDEN_RE, " ")


def plain_text(html: Column) -> Column:
    """Text of a fragment: one line per block, blanks squeezed, entities decoded."""
    lines = F.regexp_replace(html, BREAK_RE, "\n")
    text = unescape(F.regexp_replace(lines, TAG_RE, ""))
    text = F.regexp_replace(F.regexp_replace(text, BLANKS_RE, " "), NEWLINES_RE, "\n")
    return F.btrim(text, F.lit(" \n"))


def article_text(visible_html: Column) -> Column:
    """Text of the ``<article>`` element without navigation, header, footer, asides."""
    body = F.regexp_extract(visible_html, ARTICLE_RE, 1)
    return plain_text(F.regexp_replace(body, CHROME_RE, " "))


def paragraph_text(visible_html: Column) -> Column:
    """All paragraphs, one per line."""
    paragraphs = F.transform(all_matches(visible_html, PARAGRAPH_RE, 1), plain_text)
    return F.array_join(F.filter(paragraphs, lambda p: p != ""), "\n")


def body_text(visible_html: Column) -> Column:
    """Text of the whole body; an unclosed body runs to the end of the page."""
    return plain_text(F.regexp_extract(visible_html, BODY_RE, 1))


def head(html: Column) -> Column:
    """What comes before the end of the head: all that metadata needs."""
    return F.substring_index(html, "</head>", 1)


def meta_tags(head_html: Column) -> Column:
    """Named meta tags with content, as ``(name, content)`` in page order."""
    pairs = F.transform(all_matches(head_html, META_RE), lambda tag: F.struct(
        F.lower(F.regexp_extract(tag, NAME_RE, 1)).alias("name"),
        unescape(F.concat(*[F.regexp_extract(tag, CONTENT_RE, g) for g in (1, 2)])).alias("content"),
    ))
    return F.filter(pairs, lambda p: (p["name"] != "") & (p["content"] != ""))


def meta_values(tags: Column, *names: str) -> Column:
    """Contents of the meta tags with one of these names."""
    named = F.filter(tags, lambda t: t["name"].isin(*names))
    return F.transform(named, lambda t: t["content"])


def meta_value(tags: Column, *names: str) -> Column:
    """First non-empty content, or NULL."""
    return F.get(meta_values(tags, *names), F.lit(0))


def page_title(head_html: Column, tags: Column) -> Column:
    """Title from metadata, else from the title element; NULL without both."""
    return F.coalesce(
        meta_value(tags, "og:title"),
        or_null(plain_text(F.regexp_extract(head_html, TITLE_RE, 1))),
    )


def page_language(head_html: Column) -> Column:
    return or_null(F.lower(F.regexp_extract(head_html, LANG_RE, 1)))


def page_date(visible_html: Column, tags: Column) -> Column:
    """Publication date text from metadata or the first ``<time>``; NULL without."""
    return F.coalesce(
        meta_value(tags, "article:published_time", "date", "pubdate"),
        or_null(F.regexp_extract(visible_html, TIME_RE, 1)),
    )
