"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: any run of bytes other than blank, tab, line feed, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def text_batches(spark: SparkSession, rows: int = 512) -> None:
    """Hand texts to Python in small batches, so that long ones fit a worker's memory."""
    if int(spark.conf.get(BATCH_ROWS, "10000")) > rows:
        spark.conf.set(BATCH_ROWS, str(rows))


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of at most ``rows`` rows for what runs inside."""
    before = spark.conf.get(BATCH_ROWS, "10000")
    spark.conf.set(BATCH_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def text_slices(texts: pa.Array, most: int = 4_000_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``most`` bytes: first row, bytes, offsets into them.

    A null is an empty text. A longer text is a run of its own.
    """
    texts = texts.fill_null("")
    if pa.types.is_large_string(texts.type):
        width = np.int64
    else:
        texts, width = texts.cast(pa.string()), np.int32
    _, offsets, data = texts.buffers()
    n = len(texts)
    if not n:
        return
    at = np.frombuffer(offsets, width)[texts.offset:texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        last = min(last, n)
        yield first, raw[at[first]:at[last]], at[first:last + 1] - at[first]
        first = last


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads the bits of whole numbers, one to one."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_BASE = np.uint64(0x5851F42D4C957F2D)
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(n, 1024), _BASE, np.uint64)
        steps[0] = 1
        _POWERS = np.cumprod(steps, dtype=np.uint64)
    return _POWERS


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word; words end at the end of a text."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~_BLANK[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (~before | edge))
    ends = np.flatnonzero(before & (~inside | edge))
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, A-Z lower-cased, and each word's text number."""
    starts, ends, owner = word_spans(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), owner
    lens = ends - starts
    first = np.cumsum(lens) - lens
    inside = _LOWER[data[~_BLANK[data]]].astype(np.uint64) + np.uint64(1)
    place = np.arange(len(inside)) - np.repeat(first, lens)
    inside *= _powers(int(lens.max()))[place]
    return mixed(np.add.reduceat(inside, first) + lens.astype(np.uint64)), owner


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its k-word shingles.

    A text of fewer than k words has one shingle, its whole word sequence; a text
    without words has none.
    """
    n = len(offsets) - 1
    words, owner = word_hashes(data, offsets)
    counts = np.bincount(owner, minlength=n)
    first = np.cumsum(counts) - counts
    size = max(len(words) - k + 1, 0)
    rolled = np.zeros(size, np.uint64)
    for j in range(k):
        rolled = rolled * np.uint64(0xA0761D6478BD642F) + words[j:j + size]
    rolled = mixed(rolled)
    out = []
    for i in range(n):
        a, c = int(first[i]), int(counts[i])
        if c >= k:
            s = np.sort(rolled[a:a + c - k + 1])
            keep = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif c:
            h = np.uint64(c)
            with np.errstate(over="ignore"):
                for w in words[a:a + c]:
                    h = h * np.uint64(0xE7037ED1A0B428DB) + w
            out.append(mixed(np.array([h])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
