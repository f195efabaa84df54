"""The similarity join against all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from presslens import session
from presslens.llm import near
from tests.llm.conftest import messy_rows, prose

SPACE = "\x20\x09-\x0d"


def grams(text, k):
    words = re.findall(f"[^{SPACE}]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def expected(docs, k, percent):
    """Component by comparing every pair."""
    sets = [(i, grams(t, k)) for i, t in docs]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (i, a) in enumerate(sets):
        for y, (j, b) in enumerate(sets[:x]):
            if a and b and i is not None and j is not None and 100 * len(a & b) >= percent * len(a | b):
                parent[root(x)] = root(y)
    out = []
    for x, (i, a) in enumerate(sets):
        group = [sets[y][0] for y in range(len(sets)) if root(y) == root(x)]
        out.append((i, len(a), i if i is None else min(group)))
    return sorted(out, key=str)


def copies(n, seed, words=60, edits=4):
    r = random.Random(seed)
    base = prose(seed, words).split()
    out = []
    for _ in range(n):
        text = list(base)
        for _ in range(r.randrange(edits + 1)):
            text[r.randrange(len(text))] = f"new{r.randrange(1000)}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (1, 100), (2, 50)])
def test_groups_equal_all_pairs(spark, k, percent):
    texts = copies(60, 1) + copies(40, 2, words=30, edits=2) + copies(30, 3, words=200, edits=12) + [prose(s, 40) for s in range(40)]
    texts += [f"{prose(99, 30)} {prose(s, 30)}" for s in range(200, 240)] + texts[:5] + [t.upper() for t in texts[5:9]]
    random.Random(5).shuffle(texts)
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, near.near_groups(df, k, percent).collect()), key=str) == expected(docs, k, percent)


def test_chain_is_one_group(spark):
    words = [f"w{i}" for i in range(130)]
    docs = [(i, " ".join(words[i:i + 100])) for i in range(30)]
    df = spark.createDataFrame(docs[::-1], "doc_id long, text string")
    assert sorted(map(tuple, near.near_groups(df, 3, 90).collect()), key=str) == expected(docs, 3, 90)


def test_messy_rows(messy, nothing):
    docs = [(r[0], r[1]) for r in messy_rows() if r[0] != 12]
    rows = near.near_groups(messy.where("doc_id != 12 or doc_id is null"), 5, 80).collect()
    assert sorted(map(tuple, rows), key=str) == expected(docs, 5, 80)
    assert near.near_groups(messy, 5, 80).count() == len(messy_rows())
    assert near.near_groups(nothing).collect() == []


def test_components(spark):
    r = random.Random(2)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {x: x for link in links for x in link}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {row["class"]: row.label for row in near.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in links if a != b for x in (a, b)}


def first_round(rows, percent):
    """Pairs of the first round, and the rows that it leaves to the later ones."""
    rows = sorted(rows)  # gram, n, class, at
    batch = pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int32()), strict=True)], ["gram", "n", "class", "at"])
    out = [r for b in near._first_round(percent)(iter([batch])) for r in b.to_pylist()]
    return {(r["a"], r["b"]) for r in out if r["b"] is not None}, {(r["gram"], r["a"]) for r in out if r["b"] is None}


def test_rows_without_compatible_rows_beyond_neighbours_are_done():
    spread = [(1, int(100 * 1.2**i), i, 0) for i in range(40)]
    late = [(2, 100, 100 + i, 9) for i in range(30)]
    alike = [(3, 100, 200 + i, 0) for i in range(40)]
    _, left = first_round(spread + late + alike, 90)
    assert left == {(3, c) for _, _, c, _ in alike}


@pytest.mark.parametrize("percent", [90, 80, 50, 100])
def test_no_admitted_pair_is_lost_by_the_first_round(percent):
    r = random.Random(percent)
    rows = []
    for gram in range(60):
        sizes = [r.randrange(10, 10 + r.choice([3, 40, 400])) for _ in range(r.choice([3, 6, 12, 80]))]
        rows += [(gram, n, 1000 * gram + i, r.randrange(max(1, n * (100 - percent) // 100 + 1))) for i, n in enumerate(sizes)]
    pairs, left = first_round(rows, percent)
    for g, n, a, at in rows:
        for h, m, b, bt in rows:
            if g == h and a < b and near._admitted(*(np.array([x]) for x in (n, m, at, bt)), percent)[0]:
                assert (a, b) in pairs or {(g, a), (g, b)} <= left


def test_only_classes_with_copies_are_written_again(spark, monkeypatch):
    kept = []

    def recorded(df, name):
        kept.append((name, out := session.written(df, name)))
        return out

    monkeypatch.setattr(near, "written", recorded)
    docs = [(9, prose(1, 30)), (3, prose(1, 30)), (3, prose(1, 30)), (3, prose(2, 30)), (4, prose(3, 30)), (None, prose(3, 30)), (None, prose(4, 30)), (5, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for most in (near.SENT_IDS, 0):
        kept.clear()
        monkeypatch.setattr(near, "SENT_IDS", most)
        join = near.Join(df, 3, 90)
        assert sorted(r.doc_id for r in join.classes.collect()) == [3, 3, 4]
        assert join.classes.select("class").distinct().count() == 3
        assert [r.doc_id for r in dict(kept)["classes"].collect()] == [3]
        rows = {(r.doc_id, r.component_id) for r in join.documents().collect()}
        assert rows == {(9, 3), (3, 3), (4, 4), (None, None), (5, 5)}
        assert "edges" not in dict(kept)  # no link: no components to find


def test_bitmaps_of_large_sets_tell_them_apart():
    r = np.random.default_rng(1)
    both = r.integers(0, 1 << 63, 4000, np.uint64)
    sets = {end: np.unique(np.concatenate([both, r.integers(0, 1 << 63, more, np.uint64)])) for end, more in (("near", 150), ("far", 1500), ("base", 150))}
    base = sets.pop("base")
    assert near.wide_bitmap(base[:1024]) is None and len(near.wide_bitmap(base)) == 1024
    assert (near.folded([near.wide_bitmap(base)], 128)[0].tobytes()) == near.bitmap(base, near.BITS)
    rows = [(1, i, len(base), len(s), near.wide_bitmap(base), near.wide_bitmap(s)) for i, s in enumerate(sets.values())]
    rows.append((1, 2, len(base), len(base), near.wide_bitmap(base), near.bitmap(base, near.BITS)))
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["a", "b", "n_a", "n_b", "x", "y"])
    kept = [row for b in near._bounded(80)(iter([batch, batch.slice(0, 0)])) for row in b.to_pylist()]
    assert [(row["b"], row["apart"] == 0) for row in kept] == [(0, False), (2, True)]
