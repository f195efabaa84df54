"""The article store: dedup append, score write-back, source repair, columns.

A store is a Parquet folder partitioned by ``writer`` and ``ingest_batch``. Every job
that appends has a writer name of its own, under which it numbers its batches; a
batch only ever overwrites its own partition. Running it again after a lost executor
or driver gives the same store, and jobs that number alike never meet.

Inside a batch, articles are partitioned once more by ``url_bucket``, a hash of the
URL, and sorted by URL in each file. A new batch looks up only the buckets that its
URLs fall in (partition pruning), and there reads the ``url`` column alone.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presslens import schemas
from presslens.functions.urls import backfilled_source, has_bad_host, is_missing
from presslens.operators.report import beside
from presslens.session import written
from presslens.sources.articles import is_empty_store, read_or_empty

WRITER_COLUMN = "writer"
BATCH_COLUMN = "ingest_batch"
PARTITIONS = [T.StructField(WRITER_COLUMN, T.StringType()), T.StructField(BATCH_COLUMN, T.LongType())]
URL_BUCKET = "url_bucket"
#: Buckets of stored articles by URL hash. A batch's lookup reads the buckets its URLs
#: touch; a batch writes at most this many files (and as many for rows without URL).
URL_BUCKETS = 256
#: Tasks that share the rows without a URL when a batch is written.
NULL_SPREAD = 64


def init_store(spark: SparkSession, table: str, path: str | None = None) -> None:
    """Create the articles table if it is not there.

    With ``path``, the table is the store folder itself: partitioned by writer, batch
    and URL bucket, so that ``append_batch(..., table=table)``, ``read_batches`` and
    SQL on the table read the same rows, and SQL prunes partitions as they do.
    """
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schemas.STORED.fields)
    if path is None:
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet")
        return
    keys = f"`{WRITER_COLUMN}` string, `{BATCH_COLUMN}` bigint, `{URL_BUCKET}` int"
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({columns}, {keys}) USING parquet "
        f"PARTITIONED BY ({WRITER_COLUMN}, {BATCH_COLUMN}, {URL_BUCKET}) LOCATION '{path}'"
    )
    if not is_empty_store(spark, path):  # a store that is there already: its partitions
        spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")


def insert_new(batch: DataFrame, store: DataFrame, order: str = "id") -> DataFrame:
    """Rows of the batch whose URL is new, first per URL; NULL URLs always pass.

    ``order`` is unique. New rows are decided on ``(url, order)`` alone: the first of
    each URL is an aggregate, which leaves about one row per URL and task to shuffle,
    however often a URL occurs; the store is cut to URLs of the batch, so for a batch
    of broadcast size its ``url`` column is scanned and not shuffled. Whole rows move
    once, by ``order``, and only if the list of new ones is too long to broadcast.
    """
    with_url = batch.where(F.col("url").isNotNull())
    firsts = with_url.groupBy("url").agg(F.min(order).alias("_first"))
    known = store.select("url").join(firsts.select("url"), "url", "left_semi")
    new = firsts.join(known, "url", "left_anti").select("_first")
    rows = with_url.join(new, F.col(order) == F.col("_first"), "left_semi")
    return rows.select(batch.columns).unionByName(batch.where(F.col("url").isNull()))


def insert_counts(batch: DataFrame, store: DataFrame, order: str = "id") -> DataFrame:
    """Inserted and duplicate counts of one batch against the store."""
    inserted = insert_new(batch, store, order).agg(F.count("*").alias("inserted"))
    total = batch.agg(F.count("*").alias("total"))
    return beside(inserted, total).select(
        "inserted", (F.col("total") - F.col("inserted")).alias("duplicates")
    )


def url_bucket(url: Column) -> Column:
    """Bucket of a URL, 0 to ``URL_BUCKETS - 1``; null for a null URL."""
    return F.when(url.isNotNull(), F.pmod(F.xxhash64(url), F.lit(URL_BUCKETS))).cast("int")


def touched_buckets(batch: DataFrame) -> list[int]:
    """The buckets of a batch's URLs: at most ``URL_BUCKETS`` numbers."""
    rows = batch.where(F.col("url").isNotNull()).select(url_bucket(F.col("url")).alias("b")).distinct().collect()
    return sorted(r["b"] for r in rows)


def batch_path(path: str, writer: str, batch_id: int) -> str:
    """Folder of one batch. Names are plain, so that the folder name is the value."""
    if not re.fullmatch(r"[A-Za-z][A-Za-z0-9-]*", writer):
        raise ValueError(f"a writer's name is letters, digits and hyphens, not {writer!r}")
    return f"{path}/{WRITER_COLUMN}={writer}/{BATCH_COLUMN}={int(batch_id)}"


def read_batches(
    spark: SparkSession, path: str, schema, without: tuple[str, int] | None = None,
    url_buckets: list[int] | None = None,
) -> DataFrame:
    """Stored rows, on request without one batch of one writer, or of given URL
    buckets only (both by partition pruning)."""
    bucket = T.StructField(URL_BUCKET, T.IntegerType())
    df = read_or_empty(spark, path, T.StructType([*schema.fields, *PARTITIONS, bucket]))
    if without is not None:
        df = df.where((F.col(WRITER_COLUMN) != without[0]) | (F.col(BATCH_COLUMN) != without[1]))
    if url_buckets is not None:
        df = df.where(F.col(URL_BUCKET).isin(url_buckets))
    return df.drop(WRITER_COLUMN, BATCH_COLUMN, URL_BUCKET)


def write_batch(batch: DataFrame, path: str, writer: str, batch_id: int, *, by_url: bool = False) -> DataFrame:
    """Write a batch's partition, in place of what an earlier run of it wrote.

    ``by_url``: in URL buckets, one file a bucket, sorted by URL; rows without a URL
    are spread over ``NULL_SPREAD`` files of the null bucket.
    """
    target = batch_path(path, writer, batch_id)
    if by_url:
        bucket = url_bucket(F.col("url"))
        spread = -1 - F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in batch.columns]), F.lit(NULL_SPREAD))
        (batch.withColumn(URL_BUCKET, bucket)
         .repartition(F.coalesce(F.col(URL_BUCKET), spread))
         .sortWithinPartitions(URL_BUCKET, "url")
         .write.mode("overwrite").partitionBy(URL_BUCKET).parquet(target))
    else:
        batch.write.mode("overwrite").parquet(target)
    return batch.sparkSession.read.schema(batch.schema).parquet(target).select(batch.columns)


def append_batch(
    spark: SparkSession, batch: DataFrame, path: str, batch_id: int,
    created_at: str | None = None, order: str = "id", *, writer: str = "batch", table: str | None = None,
) -> tuple[int, int]:
    """Insert-or-ignore a batch into the store; returns (inserted, duplicates).

    The batch is read three times (its buckets, write and count): hand in a written
    table, not a long plan. Only the URL buckets the batch touches are read from the
    store. Counts come from what was written, so retried tasks do not show.
    """
    buckets = touched_buckets(batch)
    store = read_batches(spark, path, schemas.STORED, without=(writer, batch_id), url_buckets=buckets)
    new = insert_new(batch, store, order).withColumn(
        "created_at", F.lit(created_at).cast("string")
    ).select(schemas.STORED.fieldNames())
    inserted = write_batch(new, path, writer, batch_id, by_url=True).count()
    if table is not None:  # a table made by init_store over this folder learns the new partitions
        batch.sparkSession.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
    return inserted, batch.count() - inserted


def unscored(store: DataFrame) -> DataFrame:
    return store.where(F.col("vader_compound").isNull())


def without_scores(articles: DataFrame, scores: DataFrame) -> DataFrame:
    """Articles that have no row in the scores table yet.

    The history of scores is cut to the articles' ids before the anti join, so it is
    not shuffled for a batch whose ids may be broadcast.
    """
    known = scores.select("id").join(articles.select("id").distinct(), "id", "left_semi")
    return articles.join(known, "id", "left_anti")


def merge_scores(store: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores put on the store's rows by id; scores that are there stay."""
    new = scores.select("id", *[F.col(c).alias(f"_{c}") for c in schemas.SENTIMENT_TYPES])
    keep = F.col("vader_compound").isNotNull()
    merged = ensure_columns(store).join(new, "id", "left")
    return merged.select(
        *[c for c in store.columns if c not in schemas.SENTIMENT_TYPES],
        *[F.when(keep, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in schemas.SENTIMENT_TYPES],
    )


def backfill_sources(articles: DataFrame) -> DataFrame:
    """Missing sources filled with the URL's domain; a projection."""
    return articles.withColumn("source", backfilled_source(F.col("source"), F.col("url")))


def repair_sources(spark: SparkSession, path: str) -> int:
    """Write the backfilled source into the stored rows; returns how many changed.

    Copy-on-write of the touched partitions only: the partitions (writer, batch, URL
    bucket) that hold a row whose source the backfill changes are computed in full
    into a stage in the shared folder, then put in place of the old ones by a
    dynamic partition overwrite; no other partition is read past its ``source`` and
    ``url`` or written. A run that stops before the swap leaves the store as it was;
    running again repairs the same rows, and a run after a whole one changes none.
    """
    keys = [WRITER_COLUMN, BATCH_COLUMN, URL_BUCKET]
    bucket = T.StructField(URL_BUCKET, T.IntegerType())
    stored = read_or_empty(spark, path, T.StructType([*schemas.STORED.fields, *PARTITIONS, bucket]))
    fixed = backfilled_source(F.col("source"), F.col("url"))
    changed = stored.where(~fixed.eqNullSafe(F.col("source")))
    touched = changed.select(*keys).distinct().collect()  # at most one row a stored partition
    if not touched:
        return 0
    count = changed.count()
    buckets: dict[tuple[str, int], list] = {}
    for r in touched:
        buckets.setdefault((r[WRITER_COLUMN], r[BATCH_COLUMN]), []).append(r[URL_BUCKET])
    chosen = F.lit(False)
    for (writer, batch), values in buckets.items():
        some = [v for v in values if v is not None]
        inside = F.col(URL_BUCKET).isin(some) if some else F.lit(False)
        if len(some) < len(values):
            inside = inside | F.col(URL_BUCKET).isNull()
        chosen = chosen | ((F.col(WRITER_COLUMN) == writer) & (F.col(BATCH_COLUMN) == batch) & inside)
    staged = written(stored.where(chosen).withColumn("source", fixed), "repair-stage")
    (staged.select(*schemas.STORED.fieldNames(), *keys).repartition(*keys).sortWithinPartitions(URL_BUCKET, "url")
     .write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path))
    return count


def backfill_count(articles: DataFrame) -> DataFrame:
    """Number of rows the backfill sets (a domain-less URL sets ``N/A`` and counts)."""
    return articles.agg(
        F.count_if(is_missing(F.col("source")) & ~has_bad_host(F.col("url"))).alias("updated")
    )


def ensure_columns(articles: DataFrame) -> DataFrame:
    """Add the sentiment columns that are not there, as NULLs."""
    missing = {
        c: F.lit(None).cast(t)
        for c, t in schemas.SENTIMENT_TYPES.items() if c not in articles.columns
    }
    return articles.withColumns(missing) if missing else articles
