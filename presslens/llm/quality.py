"""Document quality: boosted trees on histograms of document statistics.

The statistics are computed on the bytes of whole batches of texts. Trees are grown
level by level on binned features and kept as arrays, one row per tree, so scoring a
batch is ``DEPTH`` look-ups for all trees and texts at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslens.llm.common import id_remainder, shingle_sets, table, text_batches, text_slices, word_hashes, word_spans

#: Most labelled rows that a fit reads; those with the smallest hash of the id.
TRAINING_ROWS = 20_000
FOLDS = 3
HELD_OUT = 1
ROUNDS = 80
DEPTH = 4
BINS = 64
RATE = 0.15
SMOOTHING = 2.0

#: Classes of bytes: lower, upper, digit, blank, line end, UTF-8 part, sentence mark,
#: exclamation mark, bracket or quote, bar or slash, other symbol, control.
CLASSES = 12
_CLASS = np.full(256, 10, np.uint8)
for _number, _members in enumerate((
    range(97, 123), range(65, 91), range(48, 58), b" \t", b"\n\r", range(128, 256), b".,;:?-", b"!", b"()[]{}\"'`", b"|\\/",
)):
    _CLASS[list(_members)] = _number
_CLASS[[*range(9), 11, 12, *range(14, 32), 127]] = 11


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of features for each text of a slice."""
    n = len(offsets) - 1
    lens = np.diff(offsets)
    owner = np.repeat(np.arange(n), lens)
    classes = np.bincount(owner * CLASSES + _CLASS[data], minlength=n * CLASSES).reshape(n, CLASSES)
    starts, ends, of = word_spans(data, offsets)
    hashes, _ = word_hashes(data, offsets)
    words = np.bincount(of, minlength=n)
    sizes = ends - starts

    def share(flags: np.ndarray) -> np.ndarray:
        return np.bincount(of[flags], minlength=n) / np.maximum(words, 1)

    last = _CLASS[data[ends - 1]] if len(ends) else np.zeros(0, np.uint8)
    first = _CLASS[data[starts]] if len(starts) else np.zeros(0, np.uint8)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    distinct = [np.array([len(s) for s in shingle_sets(data, offsets, k)]) for k in (1, 3)]
    lines = classes[:, 4] + 1
    columns = [
        np.log1p(lens), np.log1p(words), np.bincount(of, sizes, minlength=n) / np.maximum(words, 1),
        *(classes[:, c] / np.maximum(lens, 1) for c in range(CLASSES)),
        share(last == 7), share(last >= 8), share(first >= 6), share(first == 1), share(again),
        share(sizes >= 16), share(sizes == 1),
        distinct[0] / np.maximum(words, 1), distinct[1] / np.maximum(words - 2, 1),
        np.log1p(lens / lines),
    ]
    return np.column_stack(columns).astype(np.float64)


class Forest(NamedTuple):
    """Trees of one depth: splits by level order, then the leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros((len(x), len(self.feature)), np.int64)
        tree = np.arange(len(self.feature))
        row = np.arange(len(x))[:, None]
        inner = self.feature.shape[1] if len(self.feature) else 0
        for _ in range(DEPTH if inner else 0):
            above = x[row, self.feature[tree, node]] > self.threshold[tree, node]
            node = 2 * node + 1 + above
        total = self.leaf[tree, node - inner].sum(1) if inner else np.zeros(len(x))
        return 1.0 / (1.0 + np.exp(-np.clip(self.base + total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boosted trees for the log-odds of ``y``; of one class, its smoothed rate."""
    rate = (y.sum() + 1.0) / (len(y) + 2.0)
    base = float(np.log(rate / (1 - rate)))
    inner = 2 ** DEPTH - 1
    if len(np.unique(y)) < 2:
        return Forest(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
    features, thresholds, leaves, margin = [], [], [], np.full(len(y), base)
    for _ in range(ROUNDS):
        p = 1.0 / (1.0 + np.exp(-margin))
        gradient, weight = y - p, p * (1 - p)
        feature, threshold, node = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(y), int)
        for level in range(DEPTH):
            first, width = 2 ** level - 1, 2 ** level
            local = node - first
            best = np.full(width, 1e-9)
            split = np.full(width, -1)
            for f, cut in enumerate(cuts):
                if not len(cut):
                    continue
                cell = local * BINS + binned[:, f]
                g = np.bincount(cell, gradient, width * BINS).reshape(width, BINS).cumsum(1)
                h = np.bincount(cell, weight, width * BINS).reshape(width, BINS).cumsum(1)
                total_g, total_h = g[:, -1:], h[:, -1:]
                gain = g ** 2 / (h + SMOOTHING) + (total_g - g) ** 2 / (total_h - h + SMOOTHING) - total_g ** 2 / (total_h + SMOOTHING)
                gain = gain[:, :len(cut)]
                at = gain.argmax(1)
                top = gain[np.arange(width), at]
                better = top > best
                best[better], split[better] = top[better], at[better]
                feature[first:first + width][better] = f
            for k in range(width):
                if split[k] >= 0:
                    threshold[first + k] = cuts[feature[first + k]][split[k]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        place = node - inner
        leaf = RATE * np.bincount(place, gradient, inner + 1) / (np.bincount(place, weight, inner + 1) + SMOOTHING)
        margin = margin + leaf[place]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Forest(np.array(features), np.array(thresholds), np.array(leaves), base)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [statistics(data, at) for _, data, at in text_slices(batch.column(1))]
        if parts:
            rows = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(rows), pa.list_(pa.float64()))], ["doc_id", "x"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAINING_ROWS) -> Forest:
    """Fit on at most ``most`` labelled documents outside the held-out fold.

    Null ids and labels are left out; of several labels of an id the largest counts,
    of several documents of an id the one with the smallest features.
    """
    text_batches(docs.sparkSession)
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .where(id_remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
        .groupBy("doc_id").agg(F.max(label).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi")  # ``most`` ids
    x = texts.mapInArrow(_featured, "doc_id bigint, x array<double>").groupBy("doc_id").agg(F.min("x").alias("x"))
    rows = sorted(x.join(known, "doc_id").select("doc_id", "x", "label").collect())  # at most ``most`` rows
    return fit(np.array([r[1] for r in rows]).reshape(len(rows), -1 if rows else 0), np.array([float(r[2] >= 1) for r in rows]))


def scores(docs: DataFrame, forest: Forest, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``score`` of every row; null texts score as empty ones."""
    text_batches(docs.sparkSession)
    columns = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("scored text"))
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add("score", "double")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [forest.score(statistics(data, at)) for _, data, at in text_slices(batch.column(len(keep)))]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], [*keep, "score"])

    return columns.mapInArrow(scored, schema)


def accepted(docs: DataFrame, forest: Forest, bar: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores ``bar`` or more, unchanged."""
    text_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [forest.score(statistics(data, where)) for _, data, where in text_slices(batch.column(at))]
            if parts:
                yield batch.filter(pa.array(np.concatenate(parts) >= bar))

    return docs.mapInArrow(kept, docs.schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document.

    Score and prediction come from the text alone. Null text: as empty. Null id: in
    the fold of the empty text. Repeated rows score alike. Without labels the score
    is 0.5; with one label value it is that value's smoothed rate. An empty table
    gives no rows. Other columns are not read.
    """
    out = scores(docs, train(docs, labels))
    return out.select(
        "doc_id", (id_remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op3_quality(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
