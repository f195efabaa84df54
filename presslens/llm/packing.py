"""Packing documents into sequences: dominance reduction, then best fit.

The sizes of an instance are whole numbers up to the capacity, so its histogram has
at most ``capacity`` rows however many documents there are. The packing is worked
out on the histogram, with bins in runs of equal content; documents then take the
places of their size by their rank among documents of that size.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Mapping
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presslens.llm.common import table, text_batches
from presslens.llm.tokens import encoder, vocabulary
from presslens.session import written

CAPACITY = 4096
END_ID = 1
PIECES = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"


class Place(NamedTuple):
    """Items ``first_rank ..`` of a size, ``each`` to a bin, in ``bins`` bins from
    ``first_bin`` on, from ``fill`` on inside each."""

    length: int
    first_rank: int
    last_rank: int
    each: int
    first_bin: int
    bins: int
    fill: int


class Plan:
    """A packing of a histogram of sizes."""

    def __init__(self, counts: Mapping[int, int], capacity: int):
        self.capacity = capacity
        self.left = {size: n for size, n in counts.items() if n}
        self.used: dict[int, int] = dict.fromkeys(self.left, 0)
        self.sizes = sorted(self.left)
        self.bins = 0
        self.places: list[Place] = []

    def put(self, size: int, n: int, each: int, first_bin: int, bins: int, fill: int) -> None:
        if n:
            self.places.append(Place(size, self.used[size], self.used[size] + n - 1, each, first_bin, bins, fill))
            self.used[size] += n
            self.left[size] -= n
            if not self.left[size]:
                self.sizes.pop(bisect_left(self.sizes, size))

    def fix(self, size: int, other: int | None, n: int) -> None:
        """``n`` bins for good, each of one ``size`` and, if given, one ``other``."""
        first, self.bins = self.bins, self.bins + n
        if other == size:
            self.put(size, 2 * n, 2, first, n, 0)
            return
        self.put(size, n, 1, first, n, 0)
        if other is not None:
            self.put(other, n, 1, first, n, size)

    def smallest_two(self) -> int:
        a = self.sizes[0]
        return a + (a if self.left[a] > 1 else self.sizes[1] if len(self.sizes) > 1 else self.capacity + 1)

    def reduce(self) -> None:
        """Fix sets that dominate every other set with their largest item.

        Two items that fill a bin dominate: whatever else may stand beside the one
        fits in the place of the other. If nothing fits beside an item it is alone;
        if at most one item fits, the largest that fits dominates the others.
        """
        for size in self.sizes[::-1]:
            rest = self.capacity - size
            if size in self.left and rest <= size and self.left[size]:
                if rest == 0:
                    self.fix(size, None, self.left[size])
                elif rest == size:
                    self.fix(size, size, self.left[size] // 2)
                elif self.left.get(rest):
                    self.fix(size, rest, min(self.left[size], self.left[rest]))
        while self.sizes:
            size = self.sizes[-1]
            rest = self.capacity - size
            alone = len(self.sizes) == 1 and self.left[size] == 1
            if alone or self.sizes[0] > rest:
                self.fix(size, None, self.left[size])
            elif self.smallest_two() > rest:
                other = self.sizes[bisect_left(self.sizes, rest + 1) - 1]
                if other == size and self.left[size] == 1:
                    other = self.sizes[-2]
                both = self.left[size] // 2 if other == size else min(self.left[size], self.left[other])
                self.fix(size, other, both)
            else:
                break

    def best_fit(self) -> None:
        """Largest first, each into the open bin that it fills best."""
        runs: dict[int, list[tuple[int, int]]] = {}
        open_rooms: list[int] = []

        def open_run(room: int, first: int, n: int) -> None:
            if n and room:
                if room not in runs:
                    runs[room] = []
                    insort(open_rooms, room)
                runs[room].append((first, n))

        while self.sizes:
            size = self.sizes[-1]
            n = self.left[size]
            i = bisect_left(open_rooms, size)
            if i < len(open_rooms):
                room = open_rooms[i]
                first, bins = runs[room].pop()
                if not runs[room]:
                    del runs[room], open_rooms[i]
            else:
                room, first = self.capacity, self.bins
                bins = -(-n // (room // size))
                self.bins += bins
            each, fill = room // size, self.capacity - room
            full = min(bins, n // each)
            self.put(size, full * each, each, first, full, fill)
            open_run(room - each * size, first, full)
            some = n - full * each if full < bins else 0
            if some:
                self.put(size, some, some, first + full, 1, fill)
                open_run(room - some * size, first + full, 1)
            touched = full + (some > 0)
            open_run(room, first + touched, bins - touched)


def packed_counts(counts: Mapping[int, int], capacity: int = CAPACITY) -> list[Place]:
    plan = Plan(counts, capacity)
    plan.reduce()
    plan.best_fit()
    return plan.places


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of each document's tokens and end id.

    Only documents longer than ``capacity`` are cut. A null text is empty: the end
    id alone.
    """
    text_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    @F.pandas_udf(PIECES)
    def cut(texts: pd.Series) -> pd.Series:
        out = []
        for ids in encoder(path).ids([t or "" for t in texts]):
            ids += end
            parts = [ids[i:i + 4 * capacity] for i in range(0, len(ids), 4 * capacity)]
            out.append([(k, k * capacity, len(p) // 4, zlib.crc32(p)) for k, p in enumerate(parts)])
        return pd.Series(out)

    return docs.select("doc_id", F.explode(cut(F.col("text"))).alias("p")).select("doc_id", "p.*")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, buckets: int = 256) -> DataFrame:
    """Places of all pieces of ``docs`` (``doc_id, text``) in sequences of ``capacity``.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``; the
    pieces of a sequence lie side by side from 0 on. Null or empty texts are one end
    id. Null and repeated ids are documents of their own. An empty table gives no
    rows. Other columns are not read. Ranks among equal lengths are counted in
    ``buckets`` by hash, so that a common length is not one task's work.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, path, capacity), "pieces").withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets))
    )
    held = cut.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("held"))
    counts = {r[0]: r[1] for r in held.groupBy("length").agg(F.sum("held")).collect()}  # at most ``capacity`` rows
    places = spark.createDataFrame(
        packed_counts(counts, capacity),
        "length bigint, first_rank bigint, last_rank bigint, each bigint, first_bin bigint, bins bigint, fill bigint",
    )
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select("length", "bucket", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.join(starts, ["length", "bucket"]).withColumn("rank", F.col("ahead") + F.row_number().over(within) - 1)
    placed = ranked.join(
        places.withColumnRenamed("length", "size"),
        (F.col("length") == F.col("size")) & F.col("rank").between(F.col("first_rank"), F.col("last_rank")),
    )
    step = F.col("rank") - F.col("first_rank")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_bin") + step % F.col("bins")).alias("sequence_id"),
        (F.col("fill") + F.expr("(rank - first_rank) div bins") * F.col("length")).alias("offset"),
    )


def op4_pack_sequences(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary())
