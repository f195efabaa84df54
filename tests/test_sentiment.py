import random
import re

import pytest

from checks import inputs
from presslens.operators import sentiment as S
from presslens.schemas import SCORES

VALENCE = {"good": 19, "bad": -25, "great": 31, "awful": -20}
POLARITY = {"good": (700_000, 600_000), "bad": (-700_000, 666_667), "odd": (0, 500_000)}
BOOST = {"very": 293_000, "slightly": -293_000}
NEGATE = {"not", "never"}


def lexicon(spark, joined=False):
    return S.Lexicon.of(
        spark.createDataFrame([(t, v * 100_000) for t, v in VALENCE.items()], "token string, valence bigint"),
        spark.createDataFrame([(t, *p) for t, p in POLARITY.items()],
                              "token string, polarity bigint, subjectivity bigint"),
        spark.createDataFrame([(t, b, False) for t, b in BOOST.items()] + [(t, None, True) for t in NEGATE],
                              "token string, boost bigint, negates boolean"),
        joined,
    )


def table(spark, texts):
    return spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "id bigint, title string, text string")


def by_hand(title, text):
    """The rule set in plain Python, on floats."""
    title, text = title or "", text or ""
    snippet = f"{title}. {text[:500]}" if text and text != "N/A" else title
    tokens = re.findall("[a-z']+", snippet.lower())
    total = pos = neg = zero = 0.0
    polarity = []
    for i, token in enumerate(tokens):
        before = [tokens[i - d] if i >= d else None for d in (1, 2, 3)]
        v = VALENCE.get(token, 0) / 10
        if v:
            boost = sum(BOOST.get(b, 0) / 1e6 * f for b, f in zip(before, (1, 0.95, 0.9)))
            v += boost if v > 0 else -boost
            if NEGATE & set(before):
                v *= -0.74
        total += v
        pos, neg, zero = pos + (v + 1 if v > 0 else 0), neg + (1 - v if v < 0 else 0), zero + (v == 0)
        if token in POLARITY:
            p, s = POLARITY[token]
            polarity.append((p / 1e6 * (-0.5 if before[0] in NEGATE else 1), s / 1e6))
    whole = pos + neg + zero
    n = len(polarity)
    return (
        total / (total * total + 15) ** 0.5,
        *((x / whole if whole else 0.0) for x in (pos, zero, neg)),
        sum(p for p, _ in polarity) / n if n else 0.0,
        sum(s for _, s in polarity) / n if n else 0.0,
    )


def random_articles(n=150):
    rng = random.Random(11)
    words = [*VALENCE, *POLARITY, *BOOST, *NEGATE, "the", "of", "day", "it's"]
    texts = [(" ".join(rng.choices(words, k=rng.randrange(0, 12))),
              rng.choice([None, "", "N/A", " ".join(rng.choices(words, k=rng.randrange(1, 200)))]))
             for _ in range(n)]
    return texts + [(None, None), ("", ""), ("!!", "N/A")]


@pytest.mark.parametrize("joined", [False, True])
def test_scores_by_brute_force(spark, joined):
    texts = random_articles()
    lex = lexicon(spark, joined)
    assert (lex.lookup is None) == joined
    rows = {r["id"]: r for r in S.score_rows(table(spark, texts), lex).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        expected, r = by_hand(*text), rows[i]
        got = [r[c] for c in ("vader_compound", "vader_pos", "vader_neu", "vader_neg",
                              "tb_compound", "tb_subjectivity")]
        assert got == pytest.approx(expected, abs=5.1e-5), text
        assert r["tb_label"] == ("positive" if r["tb_compound"] > 0.05 else
                                 "negative" if r["tb_compound"] < -0.05 else "neutral")


def test_worked_case(spark):
    row = S.score_rows(table(spark, [("not very good", None)]), lexicon(spark)).first()
    assert (row["vader_compound"], row["vader_label"]) == (-0.3865, "negative")
    assert row["tb_compound"] == 0.7  # the negator is not just before the token


def test_both_forms_agree_on_documents(spark):
    articles = inputs.articles(spark, "/root/testdata/sf0.001")
    literal = S.score_rows(articles, inputs.lexicon(spark))
    joined = S.score_rows(articles, inputs.lexicon(spark, joined=True))
    assert literal.exceptAll(joined).isEmpty() and joined.exceptAll(literal).isEmpty()
    assert literal.schema.fieldNames() == SCORES.fieldNames()


def test_a_literal_lexicon_is_bounded_and_a_joined_one_is_not(spark, monkeypatch):
    monkeypatch.setattr(S, "MAX_LITERAL_TOKENS", 2)
    with pytest.raises(ValueError, match="more than 2"):
        lexicon(spark)
    assert S.score_rows(table(spark, [("very good", None)]), lexicon(spark, joined=True)).count() == 1


@pytest.mark.parametrize("joined", [False, True])
def test_repeated_tokens_are_refused(spark, joined):
    none = spark.createDataFrame([], "token string, polarity bigint, subjectivity bigint")
    mods = spark.createDataFrame([("not", None, True)], "token string, boost bigint, negates boolean")
    twice = spark.createDataFrame([("a", 1), ("a", 2)], "token string, valence bigint")
    with pytest.raises(ValueError, match="twice"):
        S.Lexicon.of(twice, none, mods, joined)


def test_both_forms_give_every_row_its_own_score(spark):
    rows = [(1, "good", None), (1, "bad", None), (None, "good", None), (None, "not good", "very bad"), (1, "good", None), (2, None, None)]
    df = spark.createDataFrame(rows, "id bigint, title string, text string")
    literal, joined = S.score_rows(df, lexicon(spark)), S.score_rows(df, lexicon(spark, joined=True))
    assert literal.count() == len(rows)
    assert literal.exceptAll(joined).isEmpty() and joined.exceptAll(literal).isEmpty()


def test_tokens_with_letters_of_any_script(spark):
    df = spark.createDataFrame([(1, "C'est très bien été", None), (2, "हिन्दी में समाचार", None)], "id bigint, title string, text string")
    words = [r[0] for r in df.select(S.snippet_tokens()).collect()]
    assert words == [["c'est", "très", "bien", "été"], ["हिन्दी", "में", "समाचार"]]


def test_large_literal_lexicon(spark):
    n = 3000
    tokens = ["".join(chr(97 + (i // 26 ** k) % 26) for k in range(4)) for i in range(n)]
    lex = S.Lexicon.of(
        spark.createDataFrame([(t, (i % 40 + 1) * 100_000) for i, t in enumerate(tokens)],
                              "token string, valence bigint"),
        spark.createDataFrame([], "token string, polarity bigint, subjectivity bigint"),
        spark.createDataFrame([("not", None, True)], "token string, boost bigint, negates boolean"),
    )
    rows = S.score_rows(table(spark, [(t, None) for t in tokens]), lex).orderBy("id").collect()
    for i, r in enumerate(rows):
        v = (i % 40 + 1) / 10
        assert r["vader_compound"] == pytest.approx(v / (v * v + 15) ** 0.5, abs=5.1e-5)


def test_own_scorer_hook(spark):
    import pandas as pd
    from pyspark.sql import functions as F

    @F.pandas_udf("double")
    def shouting(snippet: pd.Series) -> pd.Series:
        return snippet.str.count("!") / 3.0

    df = S.score_with(table(spark, [("hey!", "N/A"), ("so", "what!!")]), shouting, "mine")
    assert [r["mine"] for r in df.orderBy("id").collect()] == [0.3333, 0.6667]
