"""Mixing against a plain reading of its rules."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from presslens.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string"


def shared(sizes, weights=(5.0, 2.0, 1.0), most=3):
    """Targets by resharing what is above the limit, again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, left = set(), float(sum(sizes.values()))
    while True:
        some = [s for s in names if s not in full]
        total = sum(weight[s] for s in some)
        target = {s: left * weight[s] / total for s in some} | {s: float(most * sizes[s]) for s in full}
        above = [s for s in some if target[s] > most * sizes[s]]
        if not above:
            return target
        full |= set(above)
        left = sum(sizes.values()) - sum(most * sizes[s] for s in full)


def documents():
    rows = []
    for i in range(300):
        source = ["a", "b", "é", "z", None, "A", "tiny"][i % 7] if i % 3 else "a"
        rows.append((i, "w " * (i % 23) if source != "tiny" else "x y", source, "clash"))
    return [*rows, (None, "no id here", "b", "clash"), (5, None, "z", "c"), (5, None, "z", "c"), (7, "", "only empty", "c")]


@pytest.fixture(scope="module")
def mixed(spark):
    docs = spark.createDataFrame(documents(), SCHEMA)
    return docs, mixing.mix(docs)


def test_targets_and_taken(mixed):
    rows = mixed[1].select("row.*", F.col("size").alias("words"), "source_size", "target", "epochs", "part", "taken").collect()
    assert len(rows) == len(documents())
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.words == len((r.text or "").split())
        assert 0 <= r.taken <= 3 * r.words
        sizes[r.source] += r.words
        taken[r.source] += r.taken
    want = shared(sizes)
    assert len(want) > 6
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
    for source, target in want.items():
        assert taken[source] == pytest.approx(target, abs=1.001)


def test_weights_change_the_order_but_not_the_amount(spark):
    docs = spark.range(2000).selectExpr("id as doc_id", "'one' as source", "cast(10 as long) as n", "if(id % 2 = 0, 4.0, 0.25) as w")
    more = docs.unionByName(docs.selectExpr("doc_id + 5000 as doc_id", "'two' as source", "n", "w"))
    out = mixing.mix(more, F.col("n"), F.col("w")).where("row.source = 'two'").selectExpr("row.w as w", "part")
    part = {r.w: r.s for r in out.groupBy("w").agg(F.sum("part").alias("s")).collect()}
    assert sum(part.values()) == pytest.approx(40000 * 2 / 7, abs=1.001)
    assert part[4.0] > 3 * part[0.25]


def test_rerun_is_equal(mixed):
    key = lambda r: str(r)
    assert sorted(mixed[1].collect(), key=key) == sorted(mixed[1].repartition(7).collect(), key=key)


def test_copies_hold_the_taken_words(mixed):
    docs, out = mixed
    taken = out.agg(F.sum("taken")).first()[0]
    rows = mixing.copies(out).collect()
    assert sum(len((r.text or "").split()) for r in rows) == taken
    assert mixing.copies(out).columns == docs.columns
    texts = {r.text for r in docs.collect()}
    assert sum(r.text not in texts for r in rows) <= 7


def test_one_source_takes_itself_once(spark):
    docs = spark.createDataFrame([(1, "a b c", None, ""), (2, "d", None, "")], SCHEMA)
    assert {(r.taken, r.size) for r in mixing.mix(docs).collect()} == {(3, 3), (1, 1)}


def test_empty_and_all_empty(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    nothing = mixing.mix(spark.createDataFrame([(1, None, "a", ""), (2, "", None, "")], SCHEMA))
    assert {(r.taken, r.target) for r in nothing.collect()} == {(0, 0.0)}
