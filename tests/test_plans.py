"""What the physical plans must and must not contain."""

import pytest

from checks import inputs
from checks.catalog import QUERIES
from presslens.operators import sentiment, store, views
from presslens.operators.dedupe import keep_first
from presslens.plans.run import pages_to_try
from presslens.session import written

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "score_articles", "kpi_strip", "term_frequency", "extract_articles", "doc_summary",
    "sitemap_urls", "feed_items", "insert_new", "top_headlines_both", "feed_probe_pick",
])
def test_no_python_and_no_cross_join(spark, name):
    text = plan(QUERIES[name](spark, SF))
    for node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct",
                 "BroadcastNestedLoopJoin"):
        assert node not in text


def test_scoring_and_extraction_do_not_shuffle(spark):
    assert "Exchange" not in plan(sentiment.score_articles(inputs.articles(spark, SF), inputs.lexicon(spark)))
    from presslens.operators.extract import extract_articles

    assert "Exchange" not in plan(extract_articles(inputs.crawl(spark, SF)))


def test_costly_columns_are_computed_once(spark):
    scored = sentiment.score_articles(inputs.articles(spark, SF), inputs.lexicon(spark))
    assert plan(scored.where("vader_label = 'negative'")).count("aggregate(") == 1


def test_hot_keys_are_cut_before_the_shuffle(spark):
    df = inputs.articles(spark, SF).select("id", "url")
    assert plan(keep_first(df, "url", "id")).count("WindowGroupLimit") == 2


def wide_exchanges(text):
    """Exchanges of rows that still hold an article's text, by the columns of the node below."""
    lines = text.splitlines()
    return [line for i, line in enumerate(lines) if "Exchange" in line and "text#" in "".join(lines[i + 1:i + 2])]


def test_only_new_rows_move_whole(spark):
    saved, batch = written(inputs.store(spark, SF), "store"), written(inputs.batch(spark, SF), "batch")
    text = plan(store.insert_new(batch, saved))
    assert "partial_min" in text and "WindowGroupLimit" not in text and not wide_exchanges(text)
    scores = written(saved.select("id"), "scores")
    assert not wide_exchanges(plan(store.without_scores(saved.select("id"), scores)))


def test_the_joined_scorer_reads_text_once(spark):
    articles = written(inputs.articles(spark, SF), "articles")
    text = plan(sentiment.score_rows(articles, inputs.lexicon(spark, joined=True)))
    scans = [line for line in text.splitlines() if "FileScan" in line and "text#" in line]
    assert len(scans) == 1


def test_views_read_only_their_columns(spark):
    scored = written(
        sentiment.score_articles(inputs.articles(spark, SF), inputs.lexicon(spark)), "scored")
    text = plan(views.kpi_strip(views.relabel(scored, 0.1)))
    schema = text[text.index("ReadSchema"):].split("\n")[0]
    assert "text" not in schema and "title" not in schema
    top = plan(views.top_headlines(scored, "negative"))
    assert "TakeOrderedAndProject" in top and "PushedFilters: [IsNotNull(vader_label), EqualTo(vader_label,negative)]" in top


def test_a_short_source_list_is_broadcast_without_shuffling_articles(spark):
    scored = written(
        sentiment.score_articles(inputs.articles(spark, SF), inputs.lexicon(spark)), "scored")
    text = plan(views.filter_eligible(scored, 5))
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text


def test_wanted_pages_are_fetched_without_shuffling_pages(spark):
    pages = inputs.pages(spark, SF)
    text = plan(pages_to_try(written(pages.select("url"), "urls"), pages))
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text
