import re
from itertools import permutations

from presslens.llm import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_masks(rows):
    """Failure letters of each (doc_id, text, lang) row, in plain Python."""
    smallest = {}
    for i, t, _ in rows:
        t = t or ""
        if i is not None:
            smallest[t] = min(smallest.get(t, i), i)
    out = []
    for i, t, lang in rows:
        t = t or ""
        words = WORD.findall(t)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": re.search("[#$%&*|]", t) is not None,
            "E": i is not None and i > smallest[t],
        }
        out.append((lang or "", {k for k, v in fails.items() if v}, i))
    return out


def plain_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    masks = plain_masks(rows)
    out = {}
    for part in {p for p, _, _ in masks}:
        mine = [(f, i) for p, f, i in masks if p == part]
        removed_by = {}
        for order in permutations("ABCDE"):
            o = "".join(order)
            for step, letter in enumerate(o, 1):
                before = set(o[:step - 1])
                alive = [(f, i) for f, i in mine if not f & before]
                gone = [(f, i) for f, i in alive if letter in f]
                row = {
                    "kept": len(alive) - len(gone), "removed": len(gone),
                    "redundant": sum(1 for f, _ in mine if letter in f and f & before),
                    "unique_fails": sum(1 for f, _ in mine if f == {letter}),
                    "good_lost": sum(1 for _, i in gone if i in good),
                    "toxic_lost": sum(1 for _, i in gone if i in toxic),
                }
                out[(part, o, step)] = row
                removed_by[letter] = removed_by.get(letter, 0) + len(gone)
        for (p, o, step), row in out.items():
            if p == part:
                row["shapley"] = removed_by[o[step - 1]]
    return out


def run(spark, docs, labels):
    got = audit.audit(docs, labels).collect()
    return {(r.part, r.filter_order, r.step): {k: r[k] for k in (
        "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")} for r in got}, got


LABELS = "doc_id long, quality int, toxic int"


def test_messy_rows_match_plain_python(spark, messy):
    rows = [(r.doc_id, r.text, r.lang) for r in messy.collect()]
    labels = [(1, 1, 0), (2, 1, 1), (9, 0, 1), (12, 1, 0), (12, 0, 1), (None, 1, 1), (14, None, 1)]
    got, raw = run(spark, messy, spark.createDataFrame(labels, LABELS))
    assert got == plain_audit(rows, labels)
    assert len(raw) == 600 * 3 and {r.filter for r in raw} == set("ABCDE")
    assert all(r.filter == r.filter_order[r.step - 1] for r in raw)


def test_long_texts_copies_and_symbols(spark):
    long = " ".join(f"w{i}" for i in range(300))
    texts = [(1, long), (2, long), (3, long + " a#b"), (4, ("AB " * 300)), (5, "x " * 250), (6, None), (7, long.upper())]
    docs = spark.createDataFrame([(i, t, "en", "clash") for i, t in texts], "doc_id long, text string, lang string, row string")
    labels = [(2, 1, 0), (3, 0, 1)]
    got, _ = run(spark, docs, spark.createDataFrame(labels, LABELS))
    assert got == plain_audit([(i, t, "en") for i, t in texts], labels)
    assert got[("en", "EABCD", 1)]["removed"] == 1  # doc 2, a copy of doc 1


def test_empty_table_gives_no_rows(spark, nothing):
    assert audit.audit(nothing, spark.createDataFrame([], LABELS)).count() == 0


def test_sql_has_the_same_columns(spark, messy):
    cols = set(audit.audit(messy, spark.createDataFrame([], LABELS)).columns)
    assert {"part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost",
            "toxic_lost", "shapley"} <= cols
    for c in cols:
        assert c in audit.OP11_SQL
