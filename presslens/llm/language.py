"""Language identification with string kernels.

Two texts are as alike as the n-grams (one to ``LONGEST`` bytes) that both contain,
counted once each and divided by the geometric mean of their numbers. Landmark texts
of each language give Nyström features of that kernel; ridge regression on them, one
language against the rest, gives a score per language. A batch is scored by two
matrix products. N-grams are hashed into ``CELLS`` cells, so that a text is a row of
bits of fixed length.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presslens.llm.common import id_remainder, table, text_batches, text_slices

LONGEST = 3
CELLS = 1 << 13
#: Texts of a language that a fit reads, and how many of these are landmarks; those
#: with the smallest hash of the id.
TRAINING_TEXTS = 300
LANDMARKS = 24
RIDGE = 1e-2
SHARPNESS = 6.0
FOLDS = 5
HELD_OUT = 0
UNKNOWN = "und"

#: Letters in lower case and UTF-8 bytes are kept; all else is a blank.
_LETTER = np.full(256, 32, np.uint32)
_LETTER[128:] = np.arange(128, 256)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of cells, true where a text contains an n-gram of that cell."""
    n = len(offsets) - 1
    out = np.zeros(n * CELLS, bool)
    lens = np.diff(offsets)
    base = np.repeat(np.arange(n, dtype=np.int64) * CELLS, lens)
    place_left = np.repeat(offsets[1:], lens) - np.arange(len(data))
    code = _LETTER[data]
    gram = np.zeros(len(data), np.uint32)
    for length in range(1, LONGEST + 1):
        if len(data) < length:
            break
        size = len(data) - length + 1
        gram = gram[:size] * np.uint32(256) + code[length - 1:]
        cell = (gram + np.uint32(length << 24)) * np.uint32(2654435761)
        cell = ((cell ^ (cell >> np.uint32(15))) * np.uint32(2246822519)) >> np.uint32(32 - CELLS.bit_length() + 1)
        whole = place_left[:size] >= length
        out[base[:size][whole] + cell[whole]] = True
    return out.reshape(n, CELLS)


def unit(rows: np.ndarray) -> np.ndarray:
    x = rows.astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


class Model(NamedTuple):
    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray

    def values(self, rows: np.ndarray) -> np.ndarray:
        return (unit(rows) @ self.landmarks.T) @ self.weights


def fit(bits: list[bytes], langs: list[str]) -> Model:
    """``bits``: packed presence rows, in order of preference as landmarks."""
    names = sorted(set(langs))
    taken: dict[str, int] = {}
    chosen = []
    for i, lang in enumerate(langs):
        taken[lang] = taken.get(lang, 0) + 1
        if taken[lang] <= LANDMARKS:
            chosen.append(i)

    def rows(part: list[bytes]) -> np.ndarray:
        return np.unpackbits(np.frombuffer(b"".join(part), np.uint8)).reshape(len(part), CELLS)

    if not names:
        return Model([], np.zeros((0, CELLS), np.float32), np.zeros((0, 0), np.float32))
    landmarks = unit(rows([bits[i] for i in chosen]))
    kernel = np.vstack([unit(rows(bits[i:i + 512])) @ landmarks.T for i in range(0, len(bits), 512)]).astype(np.float64)
    values, vectors = np.linalg.eigh((landmarks @ landmarks.T).astype(np.float64))
    whiten = vectors / np.sqrt(np.maximum(values, 1e-6))
    features = kernel @ whiten
    aim = np.where(np.array(langs)[:, None] == np.array(names), 1.0, -1.0)
    solved = np.linalg.solve(features.T @ features + RIDGE * len(bits) * np.eye(features.shape[1]) / 100, features.T @ aim)
    return Model(names, landmarks, (whiten @ solved).astype(np.float32))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [r.tobytes() for _, data, at in text_slices(batch.column(2), 1_000_000) for r in np.packbits(presence(data, at), axis=1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["doc_id", "lang", "bits"])


def train(docs: DataFrame, texts: int = TRAINING_TEXTS) -> Model:
    """Fit on ``texts`` documents of each language outside the held-out fold.

    Null languages and null or empty texts are left out.
    """
    text_batches(docs.sparkSession)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    known = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0)).where(id_remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
    ids = known.select("doc_id", "lang").withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= texts)
    chosen = docs.select("doc_id", "lang", "text").join(
        F.broadcast(ids.select("doc_id", "lang")), ["doc_id", "lang"], "left_semi")  # ``texts`` ids a language
    rows = chosen.mapInArrow(_packed, "doc_id bigint, lang string, bits binary").withColumn("turn", F.row_number().over(order))
    rows = rows.where(F.col("turn") <= texts).orderBy(F.xxhash64("doc_id"), "doc_id", "lang", "bits").collect()  # ``texts`` a language
    return fit([bytes(r.bits) for r in rows], [r.lang for r in rows])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` of every document, from its whole text.

    A null text or one without a letter is ``und`` with score 0, and so is any text
    if no language was learned. Ties go to the first language by name. Repeated rows
    are predicted alike; an empty table gives no rows; other columns are not read.
    """
    text_batches(docs.sparkSession)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            names, scores = [], []
            for first, data, at in text_slices(texts, 1_000_000):
                n = len(at) - 1
                told = np.array([any(map(str.isalpha, t or "")) for t in texts.slice(first, n).to_pylist()])
                if not model.languages:
                    told[:] = False
                    value = np.zeros((n, 1))
                else:
                    value = np.vstack([
                        model.values(presence(data[at[i]:at[min(i + 256, n)]], at[i:min(i + 256, n) + 1] - at[i])) for i in range(0, n, 256)
                    ]).astype(np.float64)
                best = value.argmax(1)
                power = np.exp(SHARPNESS * (value - value.max(1, keepdims=True)))
                names += [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, told, strict=True)]
                scores.append(np.where(told, 1.0 / power.sum(1), 0.0))
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(predicted, "doc_id bigint, lang_pred string, score double")


def op10_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs)).select(
        "doc_id", (id_remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score",
    )
