"""One scheduled run over landed tables, from feeds to scores."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from presslens import schemas
from presslens.operators import csv_export, extract, store
from presslens.operators.sentiment import Lexicon
from presslens.plans.run import NothingToDo, run_batch, score_new
from presslens.sources.articles import is_empty_store


@dataclass(frozen=True)
class Folders:
    """Where a job keeps its tables, and its name as a writer in them."""

    store: str
    scores: str
    letters: str
    csv: str | None = None
    writer: str = "scheduled"


@dataclass(frozen=True)
class Outcome:
    """``summary`` is None for a run that found nothing to store."""

    first: bool
    inserted: int = 0
    duplicates: int = 0
    scored: int = 0
    csv: str = ""
    summary: DataFrame | None = None


def run_once(
    spark: SparkSession, folders: Folders, batch_id: int, lexicon: Lexicon,
    feeds: DataFrame, sites: DataFrame, docs: DataFrame, pages: DataFrame,
    *, max_per_source: int = 10, min_len: int = extract.MIN_TEXT_LENGTH, now: str,
) -> Outcome:
    """Discover, extract, keep dead letters, store, export, score.

    Every step overwrites its own partition of this batch and leaves out what other
    batches hold, so a run that stopped anywhere is run again with the same
    ``batch_id``. A run without URLs or articles stores none; what was stored before
    and has no scores is scored all the same.
    """
    writer = folders.writer
    first = is_empty_store(spark, folders.store)
    known = store.read_batches(spark, folders.store, schemas.STORED, without=(writer, batch_id))
    keep = partial(store.write_batch, path=folders.letters, writer=writer, batch_id=batch_id)
    done = Outcome(first)
    try:
        run = run_batch(
            feeds, sites, docs, pages, known, max_per_source=max_per_source, min_len=min_len,
            now=now, keep_failures=keep,
        )
        inserted, duplicates = store.append_batch(
            spark, run.articles, folders.store, batch_id, created_at=now, writer=writer)
        stamp = now.replace("-", "").replace(":", "").replace(" ", "_")
        exported = csv_export.export_csv(run.articles, folders.csv, stamp) if folders.csv else ""
        done = Outcome(first, inserted, duplicates, 0, exported, run.summary)
    except NothingToDo:
        pass
    stored = store.read_batches(spark, folders.store, schemas.STORED)
    scored = score_new(spark, stored, folders.scores, batch_id, lexicon, writer=writer)
    return Outcome(first, done.inserted, done.duplicates, scored, done.csv, done.summary)
