"""Held-out accuracy, exact tree look-up and edge cases of the two classifiers."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from presslens.llm import language, quality
from presslens.llm.common import id_remainder, text_slices
from tests.llm.conftest import messy_rows

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_quality_on_held_out_rows(documents, labels):
    scored = quality.classify(documents, labels)
    assert scored.count() == documents.count()
    held = scored.where("held_out").join(labels.select("doc_id", "quality"), "doc_id").collect()
    right = sum(r.predicted == r.quality for r in held)
    assert len(held) > 60 and right / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in held)


def test_labels_of_the_held_out_fold_are_not_read(documents, labels):
    turned = labels.withColumn("quality", F.when(id_remainder(F.col("doc_id"), 3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.train(documents, x) for x in (labels, turned))
    assert all(np.array_equal(x, y) for x, y in zip(a[:3], b[:3], strict=True))


def test_flat_trees_equal_walked_trees():
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 5))
    forest = quality.fit(x, (x[:, 0] * x[:, 1] > 0).astype(float))
    assert np.mean((forest.score(x) > 0.5) == (x[:, 0] * x[:, 1] > 0)) > 0.9
    for row, score in zip(x[:20], forest.score(x)[:20], strict=True):
        total = forest.base
        for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        assert score == pytest.approx(1 / (1 + np.exp(-total)))


def test_quality_of_messy_rows(spark, messy, nothing, labels):
    few = spark.createDataFrame([(1, 1), (3, 0), (3, 0), (None, 1), (9, None)], "doc_id long, quality int")
    rows = quality.classify(messy, few).collect()
    assert len(rows) == len(messy_rows())
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(messy, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (9, 1), (3, 1), (4, 1)], "doc_id long, quality int")
    assert {r.predicted for r in quality.classify(messy, one).collect()} == {1}
    assert quality.classify(nothing, few).collect() == []
    kept = quality.accepted(messy, quality.train(messy, one))
    assert kept.columns == messy.columns and kept.count() == len(messy_rows())


def test_language_on_held_out_rows(documents):
    model = language.train(documents)
    rows = language.identify(documents, model).join(documents.select("doc_id", "lang"), "doc_id").where(
        id_remainder(F.col("doc_id"), 5) == 0).collect()
    right = sum(r.lang_pred == r.lang for r in rows)
    assert len(rows) > 150 and right / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_presence_is_that_of_each_text_alone():
    texts = ["The cat", "", "été 12", None, "the CAT sat", "x"]
    (_, data, at), = text_slices(pa.array(texts, pa.string()))
    together = language.presence(data, at)
    for row, text in zip(together, texts, strict=True):
        alone = list(text_slices(pa.array([text], pa.string())))
        assert np.array_equal(row, language.presence(*alone[0][1:])[0])
    assert not together[1].any() and (together[0] & ~together[4]).sum() == 0


def test_language_of_messy_rows(messy, nothing):
    model = language.train(messy)
    rows = language.identify(messy, model).collect()
    assert len(rows) == len(messy_rows())
    texts = {r[0]: r[1] for r in messy_rows()}
    for r in rows:
        if r.doc_id not in (None, 12):
            letters = any(map(str.isalpha, texts[r.doc_id] or ""))
            assert (r.lang_pred == "und") == (not letters)
    assert language.identify(nothing, model).collect() == []
    unlearned = language.train(nothing)
    assert {r.lang_pred for r in language.identify(messy, unlearned).collect()} == {"und"}
