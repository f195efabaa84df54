"""Fingerprints against a plain reading of their rules."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from presslens.llm import spots
from tests.llm.conftest import messy_rows, prose


def edited_texts(rows):
    """Expected edited text per row, in the order of ids."""
    order = sorted(((i is not None, i or 0, t or "") for i, t in rows), key=lambda r: r[:2])
    out = []
    for k, (named, i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][2]
        half = len(text) // 2
        out.append((i if named else None, text, text[:len(text) - half] + after[:half]))
    return out


@pytest.mark.parametrize("n", [1, 2, 37, 300])
def test_edited_texts_follow_the_ids(spark, n):
    r = random.Random(n)
    ids = r.sample(range(-50, 10_000), n)
    rows = [(i, None if i % 9 == 0 else prose(i, r.randrange(30))) for i in ids]
    got = spots.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    want = {i: (len(t), hashlib.sha256(e.encode()).hexdigest()) for i, t, e in edited_texts(rows)}
    assert {x.doc_id: (x.n_chars, x.edited_sha256) for x in got} == want and len(got) == n


def test_messy_rows(messy, nothing):
    rows = spots.fingerprints(messy).collect()
    assert len(rows) == len(messy_rows())
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert {r.fingerprint for r in rows if r.n_chars == 0} == {""}
    assert spots.fingerprints(nothing).collect() == []
    by_text = {}
    for r in messy.select("text", spots.fingerprint(spots.spots(F.col("text"))).alias("f")).collect():
        assert by_text.setdefault(r.text or "", r.f) == r.f


def test_spots_are_anchors_with_content_words(spark):
    text = "The cat, of THE big house and dogs " + " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(text,)], "text string")
    mark = spots.MARK
    want = [(f"the{mark}cat", "big"), (f"of{mark}the{mark}big", "house"), (f"and{mark}dogs", "w0")]
    hashes = spark.createDataFrame(want, "a string, b string").select(F.hash("a", "b")).collect()
    assert df.select(spots.spots(F.col("text"))).first()[0] == sorted(h[0] for h in hashes)


def test_likeness_falls_with_edits(spark):
    base = prose(1, 400).split()
    rows = []
    for share in (0, 10, 50, 100):
        r = random.Random(share)
        rows.append((share, " ".join(f"other{r.random()}" if r.randrange(100) < share else w for w in base)))
    df = spark.createDataFrame(rows, "share int, text string").select("share", spots.spots(F.col("text")).alias("s"))
    first = df.where("share = 0").select(F.col("s").alias("a"))
    values = [r[1] for r in df.join(first).select("share", spots.likeness(F.col("a"), F.col("s"))).orderBy("share").collect()]
    assert values[0] == 1 and values == sorted(values, reverse=True) and values[1] > 0.4 and values[3] == 0


def test_similar_pairs_equal_all_pairs(spark):
    r = random.Random(4)
    sets = [sorted(r.sample(range(60), r.randrange(1, 30))) for _ in range(120)]
    for k in range(60):
        s = set(sets[k])
        s ^= set(r.sample(range(60), r.randrange(4)))
        sets.append(sorted(s) or [1])
    rows = [*enumerate(sets), (None, [1, 2]), (999, [])]
    got = spots.similar(spark.createDataFrame(rows, "doc_id long, spots array<int>"), 70).collect()
    least = {}
    for i, s in enumerate(sets):
        least.setdefault(tuple(s), i)
    names = sorted(least.items(), key=lambda x: x[1])
    want = {(i, j) for a, i in names for b, j in names if i < j and 100 * len({*a} & {*b}) >= 70 * len({*a} | {*b})}
    assert {(r.class_id, r.other_id) for r in got} == want and want


def test_near_copies_stay_alike_at_every_length(spark):
    words = prose(11, 90).split()
    rows = [(n, " ".join(words[:n]), " ".join(words[:n - 1])) for n in range(30, 91)]
    df = spark.createDataFrame(rows, "n int, a string, b string").repartition(4)
    like = df.select("n", spots.likeness(spots.text_spots(F.col("a")), spots.text_spots(F.col("b"))).alias("like")).collect()
    assert min(r.like for r in like) >= 0.6


def test_long_texts_without_common_anchors_have_spots_by_length(spark):
    r = random.Random(3)
    rows = []
    for n in (50, 200, 800):
        words = [f"mot{r.randrange(10 ** 6)}" for _ in range(n)]
        half = words[:n // 2] + [f"alt{r.randrange(10 ** 6)}" for _ in range(n - n // 2)]
        rows.append((n, "the " + " ".join(words), "the " + " ".join(half)))
    df = spark.createDataFrame(rows, "n int, a string, b string")
    a, b = spots.text_spots(F.col("a")), spots.text_spots(F.col("b"))
    for x in df.select("n", F.size(a).alias("size"), spots.likeness(a, b).alias("like")).collect():
        assert x.size >= x.n / 6 and 0.15 <= x.like <= 0.55


def test_near_edited_of_a_long_text_with_one_anchor(spark):
    r = random.Random(5)
    rows = [(i, "the " + " ".join(f"mot{r.randrange(10 ** 6)}" for _ in range(120))) for i in range(6)]
    got = spots.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(0.1 <= x.near_edited <= 0.6 and len(x.fingerprint) >= 8 * 20 for x in got)
