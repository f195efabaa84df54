"""Shards, exact search and secret scans against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from presslens.llm import secrets, sharding, topk
from tests.llm.conftest import messy_rows


@pytest.mark.parametrize(("axes", "bits"), [(2, 4), (3, 3)])
def test_the_curve_visits_every_cell_and_moves_one_step(axes, bits):
    grid = np.indices((1 << bits,) * axes).reshape(axes, -1)
    index = sharding.hilbert_index(list(grid), bits)
    order = grid[:, np.argsort(index)]
    assert sorted(index) == list(range(1 << (axes * bits)))
    assert (np.abs(np.diff(order, axis=1)).sum(0) == 1).all()


def test_shards_are_equal_runs(spark, messy, nothing):
    rows = sharding.shards(messy, 4).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in messy_rows())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in held.values())
    assert max(map(len, held.values())) - min(map(len, held.values())) <= 1 and set(held) == {0, 1, 2, 3}
    places = defaultdict(list)
    for r in rows:
        places[r.text_crc32].append((r.shard, r.slot))
    order = sorted((r.shard, r.slot) for r in rows)
    for group in places.values():
        at = sorted(order.index(p) for p in group)
        assert at == list(range(at[0], at[0] + len(at)))
    assert sharding.shards(nothing, 4).collect() == []


def test_a_shard_covers_a_small_box(spark):
    docs = spark.range(4000).selectExpr(
        "id as doc_id", "repeat('x', cast(pow(2, id % 12) as int)) || id as text",
        "concat('l', id % 3) as lang", "concat('s', id % 8) as source")
    rows = sharding.shards(docs, 24).join(docs.select("doc_id", "lang", "source"), "doc_id")
    kinds = rows.groupBy("shard").agg(F.countDistinct("lang", "source").alias("k")).agg(F.avg("k")).first()[0]
    assert kinds < 12  # of 24


def brute(vectors, k, step):
    out = []
    width = max(len(v) for _, v in vectors)
    full = [(i, np.array(v + [0] * (width - len(v)), dtype=object)) for i, v in vectors]
    asked = {}
    for i, v in vectors:
        if i % step == 0:
            asked[i] = max(asked.get(i, b""), np.array(v, "<i8").tobytes())
    for i, v in asked.items():
        q = np.array(list(np.frombuffer(v, "<i8")) + [0] * (width - len(v) // 8), dtype=object)
        best = sorted(((-int(q @ w), j) for j, w in full if j != i))[:k]
        out += [(int(i), rank, int(j), -s) for rank, (s, j) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_top_k_equals_brute_force(spark, seed):
    r = random.Random(seed)
    centres = [[r.randrange(-60, 60) for _ in range(6)] for _ in range(5)]
    vectors = [(i, [c + r.randrange(-4, 5) for c in r.choice(centres)]) for i in range(400)]
    vectors += [(1000 + i, centres[0]) for i in range(200)]  # a common vector: ties
    vectors += [(3, [1, 2]), (20, [0] * 6), (40, [2 ** 29] * 6)] if seed == 2 else []
    df = spark.createDataFrame(vectors, "vec_id long, q array<long>").withColumn("label", F.lit("x"))
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, k=7, block=64, cells=6, sample=100)
    assert sorted(map(tuple, got.collect())) == brute(vectors, 7, 20)


def test_few_rows_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 1.0]), (1, [0.25, -1.0]), (2, None), (20, [nan, 1.0]), (4, [inf, 0.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, [])]
    df = topk.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert {r.vec_id: r.q for r in df.collect()} == {0: [32, 64], 1: [16, -64], 6: []}
    assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 512 - 4096)]
    assert topk.top_k(df.where("false"), F.col("vec_id") % 20 == 0).collect() == []


def test_pruning_skips_far_nodes():
    r = np.random.default_rng(0)
    d = np.concatenate([r.integers(-3, 4, (600, 8)) + 100, r.integers(-3, 4, (600, 8)) - 100])
    best = topk.dual_search(d[:5], np.arange(5), d, np.arange(len(d)), 5, np.full(5, -np.inf))
    for i in range(5):
        want = sorted(((int(d[i] @ d[j]), -j) for j in range(len(d)) if j != i), reverse=True)[:5]
        assert sorted(best.found[i], reverse=True) == want


@pytest.fixture(scope="module")
def forest(spark):
    return secrets.train(secrets.planted_findings(spark, 2600))


def test_secrets_of_the_documents(spark, forest):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    want = {(i, m.start(1)) for i, t in texts.items() for m in re.finditer(r'token = "([0-9a-f]{40})"', t)}
    out = secrets.scan(docs, forest)
    rows = out.select("doc_id", F.explode("findings").alias("f"), "redacted").collect()
    assert {(r.doc_id, r.f.start) for r in rows if r.f.secret} == want and want
    for r in rows:
        assert texts[r.doc_id][r.f.start:r.f.start + len(r.f.value)] == r.f.value
        assert (r.f.value in r.redacted) != r.f.secret
    clean = out.where("not exists(findings, f -> f.secret)")
    assert clean.where("redacted != text").count() == 0


def test_kinds_of_secrets_and_of_what_is_none(spark, forest):
    key = "aB3dE5fG7hJ9kL1mN3pQ5rS7tU9vW1xY3zA5bC7d"
    rows = [(1, f"aws_secret_access_key = {key}\n"), (2, "Bearer ghp_aB3dE5fG7hJ9kL1mN3pQ5rS7tU9vW1xY3zA5"), (3, "card 4424 4242900896785123 of"),
            (4, "commit 681c09b8e90e7e8c9575180f595f646cf2969054\n"), (5, "write to of.31@mail2.example.com now"), (6, f"x {key} token = \"{'ab12' * 10}\" y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [f.secret for f in r.findings] for r in secrets.scan(df, forest).collect()}
    assert found[1] == [True] and found[2] == [True] and not any(found[3] + found[4] + found[5]) and found[6][1]


def test_scan_of_messy_rows(messy, nothing, forest):
    rows = secrets.scan(messy, forest).collect()
    assert len(rows) == len(messy_rows())
    for r in rows:
        assert (r.redacted is None) == (r.text is None) and (r.text or r.findings == [])
        assert r.doc_id != 15 or [f.secret for f in r.findings] == [True, False]
    assert secrets.scan(nothing, forest).collect() == []


def test_values_after_an_unquoted_name(spark, forest):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    texts = [f"x api_key={key}", f"AUTH_TOKEN={key}\n", f"https://a.example.com/?token={key}", f"passwd={key} y", f"my_access_key_2_main={key}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.scan(df, forest).collect():
        assert [f.value for f in r.findings if f.secret] == [key] and key not in r.redacted


def test_every_planted_form_is_found_by_a_scan(spark, forest):
    texts = secrets.planted_texts(spark, 1300, start=100_000).withColumn("doc_id", F.monotonically_increasing_id())
    rows = secrets.scan(texts, forest).collect()
    right, of = Counter(), Counter()
    for r in rows:
        hit = any(f.secret and f.value == r.value for f in r.findings)
        of[r.kind] += 1
        right[r.kind] += hit == (r.label == 1)
    assert len(of) >= 13 and min(right[k] / of[k] for k in of) >= 0.9


def test_any_value_after_a_credentials_name(spark, forest):
    values = {'password = "hunter2-9x"': "hunter2-9x", "password=Tr0ub4dor&3xyz and": "Tr0ub4dor&3xyz",
              'x password = "gamik-plodo-fekab" y': "gamik-plodo-fekab", "secret_key=abkdlfjchgmaponbecdahkfjdlmcbena": "abkdlfjchgmaponbecdahkfjdlmcbena"}
    df = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    for r in secrets.scan(df, forest).collect():
        assert [f.value for f in r.findings if f.secret] == [values[r.text]] and values[r.text] not in r.redacted


def test_the_forest_is_a_fold_over_arrays(spark, forest):
    assert "WHEN" not in forest and len(secrets.walked([(0, 0.5, 0.0, 1.0)] * 24, 6)) < 25_000
    trees = [(0, 0.5, (1, -1e-05, 1.0, 0.0), (1, 2.5, 0.0, (0, 0.75, 1.0, 0.0))), 1.0, (1, 1.0, 0.0, 1.0)]

    def reached(tree, x):
        while isinstance(tree, tuple):
            at, most, yes, no = tree
            tree = yes if x[at] is not None and x[at] <= most else no
        return tree

    points = [[a, b] for a in (0.5, 0.6, 0.75, 0.8, None) for b in (-1e-05, 0.0, 1.0, 2.5, 2.6, None)]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(points)], "i int, x array<double>")
    for depth in (3, 6):
        got = rows.selectExpr("i", f"transform(array(struct(x)), f -> {secrets.walked(trees, depth)})[0] AS score").collect()
        assert [r.score for r in sorted(got)] == [sum(reached(t, p) for t in trees) / 3 for p in points]
    assert rows.selectExpr(f"transform(array(struct(x)), f -> {secrets.walked([0.0], 1)})[0] AS score").distinct().collect()[0].score == 0.0
