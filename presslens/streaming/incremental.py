"""Incremental ingest and scoring.

Both jobs read a growing folder, process what is new and stop. The store and
the scores table are the state: a URL or id that is there already is left out by
an anti join, so history of any length needs no streaming state. A checkpoint has
a writer name of its own, kept beside it, and a batch overwrites its own partition
of that writer: a batch that is run again changes nothing, and a new checkpoint,
which numbers its batches from 0 again, overwrites nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from presslens import schemas
from presslens.operators.extract import MIN_TEXT_LENGTH, accepted_articles, failed_pages, try_extract
from presslens.operators.sentiment import Lexicon
from presslens.operators.store import PARTITIONS, append_batch, read_batches, write_batch
from presslens.plans.run import score_new
from presslens.session import written
from presslens.sources.articles import folder_exists, read_or_empty

WRITER = T.StructType([T.StructField("name", T.StringType())])


def writer_of(spark: SparkSession, checkpoint: str) -> str:
    """The writer name of a checkpoint; made up at its first use."""
    path = f"{checkpoint.rstrip('/')}-writer"
    known = read_or_empty(spark, path, WRITER).first()
    if known is None:
        name = f"stream-{uuid.uuid4().hex}"
        spark.createDataFrame([(name,)], WRITER).coalesce(1).write.mode("overwrite").parquet(path)
        return name
    return known["name"]


def ingest_pages(
    spark: SparkSession, landed: str, store: str, checkpoint: str,
    *, min_len: int = MIN_TEXT_LENGTH, scraped_at: str = schemas.MISSING,
    files_per_batch: int = 1000, letters: str | None = None,
) -> None:
    """Extract newly landed pages and append the new articles to the store, and
    what fails to the dead letters, if there is a folder for them."""
    writer = writer_of(spark, checkpoint)

    def ingest(pages: DataFrame, batch_id: int) -> None:
        tried = written(try_extract(pages, min_len, scraped_at), "tried")  # read more than once below
        if letters is not None:
            write_batch(failed_pages(tried, scraped_at), letters, writer, batch_id)
        articles = accepted_articles(tried)
        if not articles.isEmpty():
            append_batch(spark, articles, store, batch_id, writer=writer)

    _run(
        spark.readStream.schema(schemas.PAGE)
        .option("maxFilesPerTrigger", files_per_batch).parquet(landed),
        ingest, checkpoint,
    )


def score_store(
    spark: SparkSession, store: str, scores: str, checkpoint: str, lexicon: Lexicon,
    *, files_per_batch: int = 1000,
) -> None:
    """Score newly stored articles into the append-only scores table; nothing to do
    while nothing was stored."""
    if not folder_exists(spark, store, schemas.STORED):
        return
    writer = writer_of(spark, checkpoint)

    def score(articles: DataFrame, batch_id: int) -> None:
        score_new(spark, articles, scores, batch_id, lexicon, writer=writer)

    _run(
        spark.readStream.schema(T.StructType([*schemas.STORED.fields, *PARTITIONS]))
        .option("maxFilesPerTrigger", files_per_batch).parquet(store),
        score, checkpoint,
    )


def _run(stream: DataFrame, each_batch, checkpoint: str) -> None:
    query = (
        stream.writeStream.foreachBatch(each_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def scored_store(spark: SparkSession, store: str, scores: str) -> DataFrame:
    """Stored articles with their scores; NULL scores where not scored yet."""
    articles = read_batches(spark, store, schemas.STORED)
    known = read_batches(spark, scores, schemas.SCORES)
    return articles.join(known, "id", "left").select(schemas.SCORED.fieldNames())
