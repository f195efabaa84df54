import random

import numpy as np

from presslens.llm import toxicity as T


def hashes(*texts):
    raw = "\n".join(texts).encode()
    data = np.frombuffer(raw, np.uint8)
    return T.folded_words(data, np.array([0, len(raw)]))[0]


def test_folding_sees_through_look_alikes():
    plain = hashes("idiot")[0]
    assert all(h == plain for h in hashes("IDIOT", "1d10t", "Idiot!!", "1D1O7", "i.d.i.o.t"))
    assert hashes("idiots")[0] != plain
    assert hashes("...")[0] == 0


def plain_pav(y):
    blocks = [[v, 1] for v in y]
    done = False
    while not done:
        done = True
        for i in range(len(blocks) - 1):
            if blocks[i][0] >= blocks[i + 1][0]:
                v = (blocks[i][0] * blocks[i][1] + blocks[i + 1][0] * blocks[i + 1][1]) / (blocks[i][1] + blocks[i + 1][1])
                blocks[i:i + 2] = [[v, blocks[i][1] + blocks[i + 1][1]]]
                done = False
                break
    return [v for v, n in blocks for _ in range(n)]


def test_isotonic_is_pool_adjacent_violators():
    r = random.Random(3)
    m = np.array([r.random() for _ in range(60)])
    y = np.array([float(r.random() < x) for x in m])
    knots, rates = T.isotonic(m, y)
    assert np.all(np.diff(rates) >= -1e-12) and np.all(np.diff(knots) >= 0)
    order = np.argsort(m, kind="stable")
    raw = np.array(plain_pav(list(y[order])))
    prior = (y.sum() + 1) / (len(y) + 2)
    got = np.interp(m[order], knots, rates)
    # every score lies between the raw block rate and the prior
    assert np.all((got - raw) * (got - prior) <= 1e-12)


def test_boost_learns_a_threshold():
    x = np.linspace(0, 1, 200)[:, None]
    y = (x[:, 0] > 0.6).astype(float)
    trees = T.boost(x, y)
    p = 1 / (1 + np.exp(-trees.margin(x)))
    assert ((p > 0.5) == (y == 1)).mean() > 0.97


def corpus(n=400, seed=5):
    r = random.Random(seed)
    filler = "the of and river stone garden table window morning letter".split()
    insults = ["idiot", "moron", "worthless", "pathetic"]
    rows, labels = [], []
    for i in range(n):
        words = [r.choice(filler) for _ in range(r.randrange(20, 200))]
        bad = i % 5 == 0
        if bad:
            for _ in range(r.randrange(1, 4)):
                words.insert(r.randrange(len(words)), r.choice(["you", "YOU"]) + " " + r.choice(insults))
        rows.append((i, " ".join(words), "en", "web", 0, "clash"))
        labels.append((i, 1, int(bad)))
    return rows, labels


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"


def test_held_out_toxic_documents_are_caught(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in T.classify(docs, lab).collect()}
    truth = {i: t for i, _, t in labels}
    held = [i for i in got if got[i].held_out]
    assert held
    assert all((got[i].predicted == 1) == (truth[i] == 1) for i in held)
    assert all(0 < r.score < 1 for r in got.values())


def test_messy_rows(spark, messy, nothing):
    rows, labels = corpus(200)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = T.classify(messy, lab).collect()
    assert len(got) == messy.count()
    assert all(0 < r.score < 1 and r.predicted in (0, 1) for r in got)
    same = [r.score for r in got if r.doc_id == 12]
    assert same[0] == same[1]
    assert T.classify(nothing, lab).count() == 0


def test_without_labels_every_text_scores_alike(spark, messy):
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    scores = {r.score for r in T.classify(messy, lab).collect()}
    assert scores == {0.5}


def test_query_runs_by_name(spark):
    df = T.op13_toxicity(spark, "/root/testdata/sf0.001")
    assert df.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert df.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
