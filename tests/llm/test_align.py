import hashlib
from collections import Counter

import pytest

from presslens.llm import align


@pytest.fixture(scope="module")
def pair():
    return align.pair()


def plain_tokens(p, text):
    """A and B tokens as (id, start, end) byte ranges; None where the text has none."""
    if not text:
        return None
    want = (" " + text).encode()
    a = p.a.encode(" " + text, add_special_tokens=False).ids
    b = p.b.encode(text)
    if b"".join(p.a_bytes[i] for i in a) != want or b"".join(p.b_bytes[i] for i in b) != want:
        return None
    out = []
    for ids, table in ((a, p.a_bytes), (b, p.b_bytes)):
        at, spans = 0, []
        for i in ids:
            spans.append((i, at, at + len(table[i])))
            at += len(table[i])
        out.append(spans)
    return out


def plain_alignment(p, rows):
    per_doc, counts = [], Counter()
    for doc_id, text in rows:
        tokens = plain_tokens(p, text)
        if tokens is None:
            per_doc.append((doc_id, 0, 0, 0, 0, [], ""))
            continue
        a, b = tokens
        links = [(x[0], y[0]) for x in a for y in b if max(x[1], y[1]) < min(x[2], y[2])]
        counts.update(links)
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, start = [], 0
        for end in ends:
            ga = [str(i) for i, s, e in a if start <= s and e <= end]
            gb = [str(i) for i, s, e in b if start <= s and e <= end]
            groups.append(",".join(ga) + "|" + ",".join(gb))
            start = end
        text = hashlib.sha256(";".join(groups).encode()).hexdigest()
        per_doc.append((doc_id, len(a), len(b), len(ends), len(links), links, text))
    best = Counter()
    for (x, y), c in counts.items():
        best[y] = max(best[y], c)
    out = []
    for doc_id, n_a, n_b, n_groups, n_links, links, text in per_doc:
        out.append((doc_id, n_a, n_b, n_groups, n_links, sum(1 for l in links if counts[l] == best[l[1]]),
                    sum(counts[l] for l in links), text))
    return sorted(out, key=repr)


TEXTS = [
    (1, "Hello world, this is a test."), (2, "Hello world, this is a test."), (3, "naïve café — straße 日本語 🙂"),
    (4, None), (5, ""), (6, "  two  blanks\tand a tab\nline"), (7, "<|endoftext|> and <s> stay text"),
    (8, "Ärger über Öl: ¿qué tal? 1234567 x=y+z"), (None, "a row without an id"), (9, "tokenization alignment!!"),
]


def test_matches_plain_python(spark, pair):
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in TEXTS], "doc_id long, text string, row string, n_a int")
    got = sorted((tuple(r) for r in align.alignment(docs).collect()), key=repr)
    assert got == plain_alignment(pair, TEXTS)


def test_messy_rows_and_empty_table(spark, pair, messy, nothing):
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    got = sorted((tuple(r) for r in align.alignment(messy).collect()), key=repr)
    assert got == plain_alignment(pair, rows)
    assert align.alignment(nothing).count() == 0


def test_long_text_has_few_irregular_groups(pair):
    text = "The quick brown fox jumps over the lazy dog. " * 2000
    a, b = pair.encode([text])[0]
    got = align.align(a, b, pair)
    assert got["n_links"] >= max(len(a), len(b))
    assert len(got["ident"]) > 0.5 * got["n_links"]


def test_query_runs_by_name(spark):
    df = align.op12_token_alignment(spark, "/root/testdata/sf0.001")
    assert df.columns[:8] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert df.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()


def test_units_of_odd_blanks_equal_whole_texts(pair):
    import random

    r = random.Random(7)
    parts = ["a", "the", "don't", "'s", "é", "日本", "🙂", "́", "▁", "\x00", "\x1c", "\x85", "\xa0", "1234", "!!", "<s>", "\n", "\t", " ", "  ", " \n", "\n "]
    texts = ["".join(r.choice(parts) + " " * r.randrange(2) for _ in range(r.randrange(1, 30))) for _ in range(600)] + ["", None, " ", "▁", "a▁b c"]
    known = align.Units(pair)
    for at in range(0, len(texts), 50):
        for text, row in zip(texts[at:at + 50], known.rows(texts[at:at + 50]), strict=True):
            want = known.whole(text) if text else align.NO_TOKENS
            assert [list(x) for x in row[:1] + row[2:]] == [list(x) for x in want[:1] + want[2:]], text
            assert row[1] == want[1], text


def test_a_distinct_word_is_encoded_once(pair, monkeypatch):
    handed, encode = [], pair.encode
    monkeypatch.setattr(pair, "encode", lambda texts: handed.extend(texts) or encode(texts))
    known, text = align.Units(pair), "the same few words again and again " * 50 + "end"
    for _ in range(20):
        known.rows([text, text.replace("few", "many")])
    assert sum(map(len, handed)) < len(text)
