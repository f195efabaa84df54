from presslens.operators import extract

LONG = "Word and more words. " * 10


def page(body="", head="", attrs=""):
    return f"<html{attrs}><head>{head}</head><body>{body}</body></html>"


def run(spark, *htmls, min_len=100):
    pages = spark.createDataFrame(
        [(i, f"https://www.a.com/n/{i}", h) for i, h in enumerate(htmls)],
        "page_id bigint, url string, html string")
    return extract.try_extract(pages, min_len, "now")


def one(spark, html, **kw):
    return run(spark, html, **kw).first()["article"]


def test_first_layer_with_all_metadata(spark):
    head = """<title>Plain &amp; simple</title>
    <meta content="Ann" name="author"><meta name='author' content='Ben'>
    <META NAME="Description" CONTENT="About &lt;it&gt;"><meta name="keywords" content="a, b">
    <meta property="og:site_name" content="https://www.site.org/"><meta name="date" content="2025-01-02T03:04">"""
    body = f"<nav><p>{LONG}</p></nav><article><h1>H</h1><p>{LONG}</p><!-- c --><script>x('</p>')</script></article>"
    a = one(spark, page(body, head, ' class="x" lang="en-GB"'))
    assert a["extracted_by"] == "layer1" and a["title"] == "Plain & simple"
    assert a["authors"] == "Ann, Ben" and a["summary"] == "About <it>" and a["tags"] == "a, b"
    assert a["source"] == "site.org" and a["date"] == "2025-01-02" and a["language"] == "en-gb"
    assert a["text"] == "H\n" + LONG.strip() and a["scraped_at"] == "now"


def test_first_layer_needs_no_title_and_fills_missing(spark):
    a = one(spark, page(f"<article>{LONG}</article>"))
    assert (a["extracted_by"], a["title"], a["authors"], a["date"], a["summary"], a["tags"], a["language"]) == (
        "layer1", "N/A", "N/A", "N/A", "N/A", "N/A", "N/A")
    assert a["source"] == "a.com"


def test_second_layer_on_paragraphs(spark):
    a = one(spark, page(f"<div><p>{LONG}</p><p> </p><p>End</p></div>", "<title>T</title>", ' lang="en"'))
    assert a["extracted_by"] == "layer2" and a["text"] == LONG.strip() + "\nEnd"
    assert a["tags"] == "word, words, end" and a["language"] == "N/A" and a["summary"].startswith("Word")


def test_third_layer_on_body(spark):
    head = '<title>T</title><meta property="article:tag" content="x"><meta property="article:tag" content="y">'
    a = one(spark, page(f"<div>{LONG}</div>", head, ' lang="hi"'))
    assert a["extracted_by"] == "layer3" and a["tags"] == "x, y" and a["language"] == "hi"
    unclosed = f"<html><head><title>T</title></head><body>{LONG}"
    assert one(spark, unclosed)["extracted_by"] == "layer3"


def test_titles_are_needed_by_later_layers(spark):
    assert one(spark, page(f"<p>{LONG}</p>")) is None
    assert one(spark, "") is None


def test_length_bound_is_inclusive(spark):
    body = "<article>" + "x" * 100 + "</article>"
    assert one(spark, page(body))["extracted_by"] == "layer1"
    assert one(spark, page(body), min_len=101) is None


def test_accepted_and_failed_are_all_pages(spark):
    tried = run(spark, page(f"<article>{LONG}</article>"), page("x"), page(f"<p>{LONG}</p>", "<title>t</title>"), "")
    assert tuple(extract.extract_counts(tried).first()) == (4, 2, 2)
    ok = {r["id"] for r in extract.accepted_articles(tried).collect()}
    bad = {r["url"] for r in extract.failed_pages(tried, "now").collect()}
    assert ok == {0, 2} and bad == {"https://www.a.com/n/1", "https://www.a.com/n/3"}
