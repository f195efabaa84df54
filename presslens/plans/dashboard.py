"""The scored view an analyst's page starts from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from presslens.functions.labels import NEUTRAL_BOUND
from presslens.operators.sentiment import Lexicon, score_articles
from presslens.operators.store import backfill_sources
from presslens.operators.views import filter_eligible, filter_sources, relabel
from presslens.sources.articles import load_articles


def scored_view(
    articles: DataFrame, lexicon: Lexicon, *,
    selected: Sequence[str] | None = (), min_articles: int = 1,
) -> DataFrame:
    """Articles with repaired sources and scores, in the columns of the views.

    The source selection comes before scoring: it needs no scores, and what it
    drops need not be scored. ``None`` is the starting selection, all sources
    with at least ``min_articles``; an empty one filters nothing.
    """
    repaired = backfill_sources(articles)
    rows = (
        filter_eligible(repaired, min_articles) if selected is None
        else filter_sources(repaired, selected)
    )
    return load_articles(score_articles(rows, lexicon), newest_first=False)


def selected_view(
    scored: DataFrame, *, selected: Sequence[str] | None = None,
    min_articles: int = 1, bound: float = NEUTRAL_BOUND,
) -> DataFrame:
    """The same on stored scores: source filter, then labels at the chosen bound."""
    rows = (
        filter_eligible(scored, min_articles) if selected is None
        else filter_sources(scored, selected)
    )
    return relabel(rows, bound)
