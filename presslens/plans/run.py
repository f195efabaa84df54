"""Batch run over landed tables: discover, extract, store, report.

Stages hand over by written tables in the shared folder, so a stage is computed
once although several later ones read it, and a lost executor costs only tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presslens import schemas
from presslens.operators import extract, report, store
from presslens.operators.discover import discover_all
from presslens.operators.sentiment import Lexicon, score_rows
from presslens.session import written
from presslens.sources.sitemaps import parse_sitemaps


class NothingToDo(RuntimeError):
    """A stage handed over no rows."""


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise NothingToDo(f"no {what}")
    return df


def pages_to_try(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """The newest landed page of each discovered URL, if there is one.

    Pages are cut to wanted ids on their narrow columns first; that list is
    written, so that Spark knows its size, and the wide ``html`` is fetched by
    page id last: without shuffling the pages if the list may be broadcast.
    """
    landed = pages.select("url", "page_id").join(urls.select("url"), "url", "left_semi")
    newest = landed.groupBy("url").agg(F.max("page_id").alias("page_id"))
    return pages.join(written(newest.select("page_id"), "page_ids"), "page_id", "left_semi")


@dataclass(frozen=True)
class Run:
    urls: DataFrame
    tried: DataFrame
    articles: DataFrame
    failures: DataFrame
    summary: DataFrame


def run_batch(
    feeds: DataFrame, sites: DataFrame, docs: DataFrame, pages: DataFrame, known: DataFrame,
    *, max_per_source: int = 10, min_len: int = extract.MIN_TEXT_LENGTH,
    now: str = "N/A", keep_failures: Callable[[DataFrame], object] | None = None,
) -> Run:
    """One run against the stored articles ``known``; raises ``NothingToDo``
    when no URL was discovered or no article extracted.

    ``keep_failures`` is handed the dead letters before that, so that a run in
    which every page fails leaves them.
    """
    parsed = written(parse_sitemaps(docs, max_per_source), "sitemaps")
    urls = written(
        discover_all(feeds, sites, parsed, max_per_source).select("url"), "urls"
    )
    require_rows(urls, "URLs discovered")
    tried = written(extract.try_extract(pages_to_try(urls, pages), min_len, now), "tried")
    unread = urls.join(tried.select("url"), "url", "left_anti").select(
        F.lit(now).alias("failed_at"), F.lit(extract.ALL_FAILED).alias("reason"), "url",
    )
    failures = extract.failed_pages(tried, now).unionByName(unread)
    if keep_failures is not None:
        keep_failures(failures)
    articles = require_rows(extract.accepted_articles(tried), "articles extracted")
    summary = report.run_summary(
        urls.agg(F.count("*").alias("n")),
        extract.extract_counts(tried),
        store.insert_counts(articles, known),
    )
    return Run(urls, tried, articles, failures, summary)


def store_run(
    spark: SparkSession, run: Run, path: str, batch_id: int, now: str,
    *, letters: str | None = None, writer: str = "batch",
) -> tuple[int, int]:
    """Append a run's articles to the store, and its dead letters to theirs, if
    there is a folder for them; returns (inserted, duplicates)."""
    if letters is not None:
        store.write_batch(run.failures, letters, writer, batch_id)
    return store.append_batch(spark, run.articles, path, batch_id, created_at=now, writer=writer)


def score_new(
    spark: SparkSession, articles: DataFrame, scores: str, batch_id: int, lexicon: Lexicon,
    *, writer: str = "batch",
) -> int:
    """Score the articles that have no scores yet into the append-only scores
    table; returns how many were written. A repeated batch writes the same rows.

    What is new is decided on ids; title and text are read for those alone.
    """
    known = store.read_batches(spark, scores, schemas.SCORES, without=(writer, batch_id))
    new = store.without_scores(articles.select("id"), known)
    wanted = articles.select("id", "title", "text").join(new.distinct(), "id", "left_semi")
    return store.write_batch(score_rows(wanted, lexicon), scores, writer, batch_id).count()
