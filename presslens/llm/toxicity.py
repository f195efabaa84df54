"""Toxicity: boosted trees over dense text features, calibrated by isotonic regression.

Features of a text: densities of a lexicon of words that mark toxic documents (learned
here from the labelled rows, after folding look-alike characters such as ``1d10t``),
how close they stand to second-person words, capitals, punctuation and the rate of
obfuscated words. Trees are grown on them by gradient boosting; the margins that
trees give rows they were not fitted on are mapped to probabilities by a monotone
step function (pool adjacent violators), so that a score of 0.7 means about 70 %.

Counting the lexicon is a distributed aggregation over all labelled training rows;
trees are fitted on a bounded sample of them (``TRAINING_ROWS``) on the driver;
scoring runs in the tasks on Arrow batches, with the model in the closure.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from presslens.llm.common import _powers, arrow_rows, id_remainder, mixed, table, text_slices, word_spans

#: Most labelled rows whose features the tree fit reads; those with the smallest hash of the id.
TRAINING_ROWS = 20_000
#: Words of the learned lexicon: those of the largest smoothed log-odds of a toxic label.
LEXICON_WORDS = 4096
#: A lexicon word is in at least this many toxic training documents.
LEAST_TOXIC_DOCS = 3
FOLDS = 3
HELD_OUT = 1
BAR = 0.7
ROUNDS = 60
DEPTH = 3
BINS = 32
RATE = 0.2
SMOOTHING = 1.0
#: Words within this many places of a second-person word are near it.
NEAR = 3

#: Second-person words of the four languages of the corpus.
SECOND_PERSON = (
    "you", "your", "yours", "yourself", "youre", "u", "ur", "ya", "thou", "thee",
    "tu", "toi", "te", "ton", "ta", "tes", "vous", "votre", "vos",
    "du", "dich", "dir", "dein", "deine", "ihr", "euch",
    "tú", "ti", "tu", "usted", "ustedes", "vosotros",
)

# Folding: A-Z lower-cased; digits and signs that stand for letters become them; other
# ASCII signs are dropped; bytes of other scripts stay.
_FOLD = np.arange(256, dtype=np.int32)
_FOLD[65:91] += 32
_FOLD[[c for c in range(33, 127) if not chr(c).isalnum()]] = -1
for _sign, _letter in zip("0134578@$", "oieastbas"):
    _FOLD[ord(_sign)] = ord(_letter)
for _digit in "269":
    _FOLD[ord(_digit)] = -1
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SIGN = np.zeros(256, bool)
_SIGN[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def folded_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per word: hash of its folded form (0: nothing left), text number, start, end."""
    starts, ends, owner = word_spans(data, offsets)
    n = len(starts)
    if not n:
        return np.zeros(0, np.uint64), owner, starts, ends
    lens = ends - starts
    first = np.cumsum(lens) - lens
    at = np.arange(int(lens.sum())) - np.repeat(first - starts, lens)
    word = np.repeat(np.arange(n), lens)
    mapped = _FOLD[data[at]]
    keep = mapped >= 0
    word, mapped = word[keep], mapped[keep].astype(np.uint64)
    counts = np.bincount(word, minlength=n)
    begin = np.cumsum(counts) - counts
    sums = np.zeros(n, np.uint64)
    some = counts > 0
    if some.any():
        place = np.arange(len(word)) - begin[word]
        values = (mapped + np.uint64(1)) * _powers(int(counts.max()))[place]
        sums[some] = np.add.reduceat(values, begin[some])
    hashes = mixed(sums + counts.astype(np.uint64))
    hashes[~some] = 0
    return hashes, owner, starts, ends


def _hash_of(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(folded_words(raw, np.array([0, len(raw)]))[0][0])


_YOU = np.unique(np.array([_hash_of(w) for w in SECOND_PERSON], np.uint64))


class Lexicon(NamedTuple):
    """Sorted word hashes and the smoothed log-odds of a toxic label of each."""

    words: np.ndarray
    weights: np.ndarray

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Weight of each hash; 0 where it is not in the lexicon."""
        if not len(self.words):
            return np.zeros(len(hashes))
        at = np.clip(np.searchsorted(self.words, hashes), 0, len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.weights[at], 0.0)


NAMES = (
    "log_chars", "log_words", "lexicon_share", "lexicon_weight", "lexicon_top", "lexicon_log_hits",
    "you_share", "near_you_share", "near_you_per_word", "upper_share", "caps_words", "exclaim_rate",
    "question_rate", "repeated_marks", "sign_rate", "obfuscated_words", "obfuscated_hits",
)


def features(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """One row of ``NAMES`` for each text of a slice."""
    n = len(offsets) - 1
    lens = np.diff(offsets)
    hashes, owner, starts, ends = folded_words(data, offsets)
    words = np.bincount(owner, minlength=n).astype(float)
    per_word = np.maximum(words, 1)
    weight = lexicon.look_up(hashes)
    hit = weight > 0
    you = np.isin(hashes, _YOU)
    # second-person words within NEAR places, in the same text
    ones = np.concatenate([[0], np.cumsum(you)])
    index = np.arange(len(hashes))
    text_first = np.cumsum(words.astype(int)) - words.astype(int)
    lo = np.maximum(index - NEAR, text_first[owner] if len(owner) else index)
    hi = np.minimum(index + NEAR, (text_first + words.astype(int) - 1)[owner] if len(owner) else index)
    near_you = hit & (ones[hi + 1] - ones[lo] > 0) if len(index) else hit
    owner_bytes = np.repeat(np.arange(n), lens)
    letters = np.bincount(owner_bytes, _LETTER[data], n)
    upper = np.bincount(owner_bytes, _UPPER[data], n)
    exclaim = np.bincount(owner_bytes, data == 33, n)
    question = np.bincount(owner_bytes, data == 63, n)
    signs = np.bincount(owner_bytes, _SIGN[data], n)
    marks = np.isin(data, (33, 63))
    doubled = np.zeros(len(data), bool)
    doubled[1:] = marks[1:] & marks[:-1]
    doubled[1:] &= owner_bytes[1:] == owner_bytes[:-1] if len(data) else doubled[1:]
    repeated = np.bincount(owner_bytes, doubled, n)
    if len(starts):
        cut = np.column_stack([starts, ends]).ravel()

        def per(flags: np.ndarray) -> np.ndarray:
            return np.add.reduceat(np.concatenate([flags.astype(np.int64), [0]]), cut)[::2]

        w_letters, w_upper = per(_LETTER[data]), per(_UPPER[data])
        w_digits, w_signs = per(_DIGIT[data]), per(_SIGN[data] & ~np.isin(data, (33, 63, 46, 44, 58, 59, 39, 34)))
        caps = (w_upper >= 2) & (w_upper == w_letters)
        inner_signs = w_signs > 0
        obfuscated = (w_letters > 0) & ((w_digits > 0) | inner_signs)
    else:
        caps = obfuscated = np.zeros(0, bool)
    count = lambda flags, w=None: np.bincount(owner[flags], None if w is None else w[flags], n)
    hits = count(hit)
    top = np.zeros(n)
    if hit.any():
        np.maximum.at(top, owner[hit], weight[hit])
    columns = [
        np.log1p(lens), np.log1p(words), hits / per_word, count(hit, weight) / per_word, top, np.log1p(hits),
        count(you) / per_word, count(near_you) / np.maximum(hits, 1), count(near_you) / per_word,
        upper / np.maximum(letters, 1), count(caps) / per_word, exclaim / np.maximum(lens, 1),
        question / np.maximum(lens, 1), repeated / per_word, signs / np.maximum(lens, 1),
        count(obfuscated) / per_word, count(obfuscated & hit) / np.maximum(hits, 1),
    ]
    return np.column_stack(columns).astype(np.float64)


class Trees(NamedTuple):
    """Boosted trees of depth ``DEPTH``, split nodes in level order, then the leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        inner = 2 ** DEPTH - 1
        row = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[row, self.feature[t, node]] > self.threshold[t, node])
            out += self.leaf[t, node - inner]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Trees for the log-odds of ``y`` by Newton steps on binned features."""
    rate = (y.sum() + 1.0) / (len(y) + 2.0)
    base = float(np.log(rate / (1 - rate)))
    inner = 2 ** DEPTH - 1
    if len(y) == 0 or len(np.unique(y)) < 2:
        return Trees(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    margin = np.full(len(y), base)
    out_f, out_t, out_l = [], [], []
    rows = np.arange(len(y))
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, int), np.full(inner, np.inf)
        node = np.zeros(len(y), int)
        for k in range(inner):
            here = node == k
            best, gh, hh = 1e-9, g[here].sum(), h[here].sum()
            for f, cut in enumerate(cuts):
                if not len(cut):
                    continue
                cell = np.searchsorted(cut, x[here, f], "left")
                gs = np.bincount(cell, g[here], len(cut) + 1).cumsum()[:-1]
                hs = np.bincount(cell, h[here], len(cut) + 1).cumsum()[:-1]
                gain = gs ** 2 / (hs + SMOOTHING) + (gh - gs) ** 2 / (hh - hs + SMOOTHING) - gh ** 2 / (hh + SMOOTHING)
                j = int(gain.argmax()) if len(gain) else 0
                if len(gain) and gain[j] > best:
                    best, feature[k], threshold[k] = gain[j], f, cut[j]
            node = np.where(here, 2 * k + 1 + (x[rows, feature[k]] > threshold[k]), node)
        leaf_of = node - inner
        leaf = RATE * np.bincount(leaf_of, g, inner + 1) / (np.bincount(leaf_of, h, inner + 1) + SMOOTHING)
        margin = margin + leaf[leaf_of]
        out_f.append(feature)
        out_t.append(threshold)
        out_l.append(leaf)
    return Trees(np.array(out_f), np.array(out_t), np.array(out_l), base)


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (margins) and non-decreasing rates of ``y``."""
    if not len(y):
        return np.array([0.0]), np.array([0.5])
    order = np.argsort(margin, kind="stable")
    m, t = margin[order], y[order].astype(float)
    values, weights, lows, highs = [], [], [], []
    for a, b in zip(m, t):
        values.append((b + 0.0)), weights.append(1.0), lows.append(a), highs.append(a)
        while len(values) > 1 and values[-2] >= values[-1]:
            w = weights[-2] + weights[-1]
            values[-2] = (values[-2] * weights[-2] + values[-1] * weights[-1]) / w
            weights[-2], highs[-2] = w, highs[-1]
            del values[-1], weights[-1], lows[-1], highs[-1]
    knots = np.array([x for lo, hi in zip(lows, highs) for x in (lo, hi)])
    rates = np.repeat(np.array(values), 2)
    # a little smoothing towards the prior, so that no score is exactly 0 or 1
    prior = (t.sum() + 1) / (len(t) + 2)
    sizes = np.repeat(np.array(weights), 2)
    return knots, (rates * sizes + prior) / (sizes + 1)


class Model(NamedTuple):
    """A lexicon, trees fitted on each half of the training rows, and one calibration."""

    lexicon: Lexicon
    halves: tuple[Trees, Trees]
    knots: np.ndarray
    rates: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Mean of both halves' calibrated scores: calibration saw margins of this kind."""
        return np.mean([np.interp(t.margin(x), self.knots, self.rates) for t in self.halves], axis=0)


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``word, label``: each distinct folded word of a text once, with the text's label."""
    for batch in batches:
        labels = batch.column(2).to_numpy(zero_copy_only=False)
        for first, data, at in text_slices(batch.column(1)):
            hashes, owner, _, _ = folded_words(data, at)
            pairs = np.unique(np.column_stack([owner + first, hashes.view(np.int64)]), axis=0) if len(hashes) else np.zeros((0, 2), np.int64)
            pairs = pairs[pairs[:, 1] != 0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs[:, 1], pa.int64()), pa.array(labels[pairs[:, 0]], pa.int32())], ["word", "label"])


def learn_lexicon(texts: DataFrame, known: DataFrame) -> Lexicon:
    """Words of the largest smoothed log-odds of a toxic label, over all ``known`` rows.

    ``texts``: ``doc_id, text``; ``known``: ``doc_id, label`` (one row an id). Each
    word counts once a document row. Texts meet their labels first; words are then
    counted with a partial aggregate, so about one row a distinct word and task is
    shuffled, not one a word and document.
    """
    # a shuffle join at every size: the plan, and what it moves, grow in proportion
    words = texts.join(known.hint("shuffle_merge"), "doc_id").select("doc_id", "text", "label").mapInArrow(_word_rows, "word long, label int")
    totals = known.agg(F.sum("label").alias("bad"), F.count("*").alias("all")).first()
    bad, good = float(totals["bad"] or 0), float((totals["all"] or 0) - (totals["bad"] or 0))
    counted = words.groupBy("word").agg(F.sum("label").alias("bad"), F.count("*").alias("all"))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("all") - F.col("bad") + 0.5) / (good + 1.0))
    top = (
        counted.where(F.col("bad") >= LEAST_TOXIC_DOCS).select("word", odds.alias("w"))
        .where(F.col("w") > 0).orderBy(F.desc("w"), "word").limit(LEXICON_WORDS).collect()
    )  # at most LEXICON_WORDS rows
    pairs = sorted((np.uint64(np.int64(r["word"]).view(np.uint64)), float(r["w"])) for r in top)
    return Lexicon(np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs], float))


def _featured(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [features(data, at, lexicon) for _, data, at in text_slices(batch.column(1))]
            if parts:
                rows = np.concatenate(parts)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(rows), pa.list_(pa.float64()))], ["doc_id", "x"])
    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = TRAINING_ROWS) -> Model:
    """Lexicon from all labelled rows outside the held-out fold, trees from ``most`` of them.

    Null ids and labels are left out; of several labels of an id the largest counts;
    of several documents of an id each counts for the lexicon, the smallest features
    for the trees. Trees are fitted on each half of the sample (by a hash of the
    id); each half's margins from the other half's trees fit the calibration.
    """
    spark = docs.sparkSession
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .where(id_remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
        .groupBy("doc_id").agg(F.max((F.col(label) >= 1).cast("int")).alias("label"))
    )
    # only rows of the training folds can meet a label: the others are not shuffled
    texts = docs.where(F.col("doc_id").isNotNull() & (id_remainder(F.col("doc_id"), FOLDS) != HELD_OUT)).select("doc_id", "text")
    with arrow_rows(spark, 512):
        lexicon = learn_lexicon(texts, known)
        sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = texts.join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")  # ``most`` ids
        x = chosen.mapInArrow(_featured(lexicon), "doc_id long, x array<double>").groupBy("doc_id").agg(F.min("x").alias("x"))
        rows = sorted(x.join(sample, "doc_id").select("doc_id", "x", "label").collect())  # at most ``most`` rows
    xs = np.array([r[1] for r in rows], float).reshape(len(rows), len(NAMES))
    ys = np.array([float(r[2]) for r in rows])
    half = np.array([int(mixed(np.array([r[0]], np.uint64).astype(np.uint64))[0] & np.uint64(1)) for r in rows], int)
    margins, halves = np.zeros(len(ys)), []
    for side in (0, 1):
        halves.append(boost(xs[half != side], ys[half != side]))
        margins[half == side] = halves[-1].margin(xs[half == side])
    knots, rates = isotonic(margins, ys)
    return Model(lexicon, tuple(halves), knots, rates)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row; null texts score as empty ones."""
    columns = docs.select(F.col("doc_id"), F.col("text"))
    schema = columns.schema[:1]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.score(features(data, at, model.lexicon)) for _, data, at in text_slices(batch.column(1))]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    return columns.mapInArrow(scored, StructType(list(schema)).add("score", DoubleType()))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document.

    The score comes from the text alone (null: empty) and lies in (0, 1). A null id
    is in the fold of the empty text. Repeated rows score alike. Without labels, or
    with one value only, every text scores the smoothed rate of toxic labels. An
    empty table gives no rows. Other columns are not read.
    """
    out = scores(docs, train(docs, labels))
    return out.select(
        "doc_id", (id_remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= BAR).cast("int").alias("predicted"),
    )


def op13_toxicity(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
