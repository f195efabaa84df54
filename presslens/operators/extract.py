"""Article extraction over landed pages ``(page_id, url, html)``.

Three strategies, tried in order; the first whose text is long enough wins. All
are column expressions on one row: no shuffle, no Python worker. A strategy is
NULL when it does not accept the page, and ``coalesce`` stops at the first that
does, so later ones cost nothing for most pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presslens.functions import html as H
from presslens.functions.dates import day_of
from presslens.functions.once import with_once
from presslens.functions.text import joined_or_missing, keywords, let, or_missing, summary
from presslens.functions.urls import clean_source, url_domain
from presslens.schemas import ARTICLE_COLUMNS, MISSING

MIN_TEXT_LENGTH = 100
ALL_FAILED = "all extractors failed"

LAYERS = ("layer1", "layer2", "layer3")


def with_page_parts(pages: DataFrame) -> DataFrame:
    """What every strategy needs, computed once per page: the visible page,
    ``_title`` (NULL without) and the other metadata as ``_about``."""
    meta = F.col("_meta")
    parts = pages.withColumns({
        "_head": H.head(F.col("html")), "_visible": H.visible(F.col("html")),
    })
    parts = with_once(parts, "_meta", H.meta_tags(F.col("_head")))
    about = F.struct(
        H.page_title(F.col("_head"), meta).alias("title"),
        joined_or_missing(H.meta_values(meta, "author", "article:author")).alias("authors"),
        or_missing(day_of(H.page_date(F.col("_visible"), meta))).alias("date"),
        H.meta_value(meta, "description").alias("description"),
        H.meta_value(meta, "og:description").alias("og_description"),
        or_missing(H.meta_value(meta, "keywords")).alias("keywords"),
        joined_or_missing(H.meta_values(meta, "article:tag")).alias("tags"),
        let(
            H.meta_value(meta, "og:site_name"), lambda name: clean_source(name, F.col("url"))
        ).alias("site"),
        url_domain(F.col("url")).alias("domain"),
        or_missing(H.page_language(F.col("_head"))).alias("language"),
    )
    return with_once(parts, "_about", about)


def _record(scraped_at: str, layer: str, **fields: Column) -> Column:
    fields = {
        "authors": F.col("_about.authors"),
        "date": F.col("_about.date"),
        **fields,
        "url": F.col("url"),
        "extracted_by": F.lit(layer),
        "scraped_at": F.lit(scraped_at),
    }
    return F.struct(*[fields[c].alias(c) for c in ARTICLE_COLUMNS])


def _accepted(text: Column, min_len: int, needs_title: bool) -> Column:
    long_enough = F.length(text) >= min_len
    return long_enough & F.col("_about.title").isNotNull() if needs_title else long_enough


def layer1(min_len: int, scraped_at: str, text: Column) -> Column:
    """Article element; the title may be missing."""
    return F.when(_accepted(text, min_len, needs_title=False), _record(
        scraped_at, "layer1",
        title=F.coalesce("_about.title", F.lit(MISSING)),
        summary=F.coalesce("_about.description", "_about.og_description", F.lit(MISSING)),
        text=text,
        tags=F.col("_about.keywords"),
        source=F.col("_about.site"),
        language=F.col("_about.language"),
    ))


def layer2(min_len: int, scraped_at: str, text: Column) -> Column:
    """Paragraphs; needs a title; adds keywords and a summary; no language."""
    return F.when(_accepted(text, min_len, needs_title=True), _record(
        scraped_at, "layer2",
        title=F.col("_about.title"),
        summary=summary(text),
        text=text,
        tags=keywords(text),
        source=F.col("_about.domain"),
        language=F.lit(MISSING),
    ))


def layer3(min_len: int, scraped_at: str, text: Column) -> Column:
    """Whole body; needs a title."""
    return F.when(_accepted(text, min_len, needs_title=True), _record(
        scraped_at, "layer3",
        title=F.col("_about.title"),
        summary=F.coalesce("_about.description", F.lit(MISSING)),
        text=text,
        tags=F.col("_about.tags"),
        source=F.col("_about.domain"),
        language=F.col("_about.language"),
    ))


_TEXT_OF = {"layer1": H.article_text, "layer2": H.paragraph_text, "layer3": H.body_text}
_LAYER = {"layer1": layer1, "layer2": layer2, "layer3": layer3}


def _fallback(min_len: int, scraped_at: str) -> Column:
    """First accepted strategy.

    Each strategy's text is bound to a lambda variable: computed once, and only
    if the strategies before it were refused.
    """
    def bound(name: str) -> Column:
        return let(
            _TEXT_OF[name](F.col("_visible")), lambda text: _LAYER[name](min_len, scraped_at, text)
        )

    return F.coalesce(*[bound(name) for name in LAYERS])


def extract_layer(
    pages: DataFrame, layer: str, min_len: int = MIN_TEXT_LENGTH, scraped_at: str = MISSING
) -> DataFrame:
    """One strategy alone: the pages it accepts, as articles."""
    parts = with_once(with_page_parts(pages), "_text", _TEXT_OF[layer](F.col("_visible")))
    article = _LAYER[layer](min_len, scraped_at, F.col("_text"))
    return (
        with_once(parts, "article", article)
        .where(F.col("article").isNotNull())
        .select("page_id", "article.*")
    )


def try_extract(
    pages: DataFrame, min_len: int = MIN_TEXT_LENGTH, scraped_at: str = MISSING
) -> DataFrame:
    """Every page with ``article``: the first accepted strategy's record, or NULL."""
    return with_once(
        with_page_parts(pages), "article", _fallback(min_len, scraped_at)
    ).select("page_id", "url", "article")


def accepted_articles(tried: DataFrame) -> DataFrame:
    """Articles out of ``try_extract``, keyed by ``id`` (the page id)."""
    return tried.where(F.col("article").isNotNull()).select(
        F.col("page_id").alias("id"), "article.*"
    )


def failed_pages(tried: DataFrame, failed_at: str, reason: str = ALL_FAILED) -> DataFrame:
    """Dead letters out of ``try_extract``."""
    return tried.where(F.col("article").isNull()).select(
        F.lit(failed_at).alias("failed_at"),
        F.lit(reason).alias("reason"),
        "url",
    )


def extract_articles(
    pages: DataFrame, min_len: int = MIN_TEXT_LENGTH, scraped_at: str = MISSING
) -> DataFrame:
    return accepted_articles(try_extract(pages, min_len, scraped_at))


def extract_counts(tried: DataFrame) -> DataFrame:
    """Pages tried, articles accepted, pages failed."""
    ok = F.col("article").isNotNull()
    return tried.agg(
        F.count("*").alias("tried"),
        F.count_if(ok).alias("scraped"),
        F.count_if(~ok).alias("failed"),
    )
