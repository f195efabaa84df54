"""Shards cut from a Hilbert curve over document metadata."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presslens.llm.common import table
from presslens.session import written

BITS = 8
SHARDS = 24


def hilbert_index(axes: Sequence[np.ndarray], bits: int = BITS) -> np.ndarray:
    """Place of grid points on the Hilbert curve through a cube of 2**bits a side.

    Follows the published transform between axes and the transposed index: undo the
    excess work from the top bit down, Gray encode, then interleave the bits.
    """
    x = [np.asarray(a, np.int64).copy() for a in axes]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << 1) | (((x[i] ^ t) >> b) & 1)
    return index


def _curve(bits: int):
    @F.pandas_udf("long")
    def curve(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index([a.to_numpy(), b.to_numpy(), c.to_numpy()], bits))

    return curve


def size_class(size: Column, bits: int = BITS) -> Column:
    """Eighths of a power of two; the last class holds all above."""
    return F.least(F.lit(2 ** bits - 1), F.greatest(F.lit(0), F.floor(F.log2(size.cast("double")) * 8))).cast("long")


def name_class(name: Column, bits: int = BITS) -> Column:
    """A name's cell; null counts as an empty name. Names may share a cell."""
    return F.crc32(F.coalesce(name, F.lit("")).cast("binary")) % (2 ** bits)


def ranked(df: DataFrame, *order: Column | str) -> DataFrame:
    """Rows with ``rank`` (from 0, in order) and ``n_rows``, without one task that sorts all.

    Ranges are sorted apart and written with their place inside the range; the rows
    of earlier ranges are added from one count per range.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sorted_rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = sorted_rows.withColumn("range_no", F.spark_partition_id()).withColumn(
        "place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    )
    placed = written(placed, "ranked")
    counts = placed.groupBy("range_no").agg(F.count(F.lit(1)).alias("held"))
    earlier = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "range_no", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("ahead"),
        F.sum("held").over(Window.partitionBy()).alias("n_rows"),
    )
    return placed.join(starts, "range_no").withColumn("rank", F.col("ahead") + F.col("place")).drop("range_no", "place", "ahead")


def shards(docs: DataFrame, n_shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """Each row's shard and slot: equal runs of the Hilbert order.

    ``docs`` has ``doc_id, text, lang, source``. The curve runs over size, language
    and source, so a shard covers a small box of all three and a reader that filters
    on any of them skips most shards. Rows of equal text take the metadata of the one
    with the smallest id and lie side by side. Shard counts are at most one apart.

    Returns ``doc_id, size`` (UTF-8 bytes + 8), ``text_crc32, curve, shard, slot``.
    Null text: empty. Null id: first among its equals. Null language or source: a
    value of its own. Repeated rows each get a slot. Fewer rows than shards leave
    shards empty; an empty table gives no rows. Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    meta = docs.select(
        "doc_id", "lang", "source",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
    )
    meta = written(meta, "shard-meta")
    same = ["text_crc32", "text_hash", "size"]
    heads = meta.groupBy(*same).agg(
        F.count(F.lit(1)).alias("alike"), F.min(F.struct("doc_id", "lang", "source")).alias("head")
    ).where("alike > 1").drop("alike")
    led = meta.join(heads, same, "left")
    chosen = lambda c: F.when(F.col("head").isNotNull(), F.col(f"head.{c}")).otherwise(F.col(c))
    curve = _curve(bits)(size_class(F.col("size"), bits), name_class(chosen("lang"), bits), name_class(chosen("source"), bits))
    placed = led.select("doc_id", *same, curve.alias("curve"))
    order = ranked(placed, "curve", "text_hash", "text_crc32", "size", "doc_id")
    shard = F.expr(f"(rank * {n_shards}) div n_rows")
    return order.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", "curve", F.col("shard").cast("int").alias("shard"),
        (F.col("rank") - F.expr(f"(shard * n_rows + {n_shards - 1}) div {n_shards}")).alias("slot"),
    )


def op7_hilbert_shards(spark, sf_dir: str) -> DataFrame:
    out = shards(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )
