import random
import re
from collections import Counter

from pyspark.sql import functions as F

from presslens.functions import text as T
from presslens.functions.dates import parse_date



def test_title_tokens_keep_order_and_repeats(evaluate):
    got = evaluate(T.title_tokens(F.col("v")), [("Rain rain and RAIN",), ("The new UK deal: 5 cats",), ("",), (None,)])
    assert got == [["rain", "rain", "rain"], ["deal", "cats"], [], None]


def test_snippet(evaluate):
    body = "x" * 600
    rows = [("T", body), ("T", "N/A"), ("T", ""), ("T", None), (None, None), (None, "b")]
    got = evaluate(T.scoring_snippet(F.col("t"), F.col("b")), rows, "t string, b string")
    assert got == ["T. " + "x" * 500, "T", "T", "T", "", ". b"]


def test_lists_and_missing(evaluate):
    rows = [(["Alice", "Bob"],), (["Alice"],), ([],), (None,)]
    assert evaluate(T.joined_or_missing(F.col("v")), rows, "v array<string>") == [
        "Alice, Bob", "Alice", "N/A", "N/A"]
    assert evaluate(T.or_missing(F.col("v")), [("a",), ("",), (None,)]) == ["a", "N/A", "N/A"]


def test_cuts(evaluate):
    rows = [("a" * 100,), ("a" * 101,)]
    assert evaluate(T.cut_with_dots(F.col("v"), 100), rows) == ["a" * 100, "a" * 100 + "..."]
    assert evaluate(T.cut(F.col("v"), 80), rows) == ["a" * 80] * 2


def test_dates(evaluate):
    rows = [("2025-01-02",), ("2025-01-02 03:04:05",), ("Jan 2, 2025",), ("N/A",), ("soon",), (None,)]
    got = [d and str(d) for d in evaluate(parse_date(F.col("v")), rows)]
    assert got == ["2025-01-02 00:00:00", "2025-01-02 03:04:05", "2025-01-02 00:00:00", None, None, None]


def words_of(text):
    return [w for w in re.findall(r"[^\W\d_]{3,}", text.lower()) if w not in T.STOPWORDS]


def keywords_by_hand(text, k=10):
    counts = Counter(words_of(text))
    return sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:k]


def summary_by_hand(text, n=5):
    counts = dict(keywords_by_hand(text))
    parts = [s.strip(" ") for s in re.findall(r"[^.!?\n]+[.!?]*", text)]
    parts = [s for s in parts if s]
    scored = sorted(
        (-sum(counts.get(w, 0) for w in re.findall(r"[^\W\d_]{3,}", s.lower())), i, s)
        for i, s in enumerate(parts)
    )[:n]
    return " ".join(s for _, _, s in sorted(scored, key=lambda x: x[1])) or "N/A"


def random_texts(n, seed=7):
    rng = random.Random(seed)
    vocabulary = ["rain", "storm", "city", "the", "of", "market", "été", "straße", "up", "win", "loss"]
    texts = []
    for _ in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 80))]
        texts.append("".join(w + rng.choice([" ", " ", " ", ". ", "! ", "\n"]) for w in words))
    return texts


def test_keywords_and_summary_by_brute_force(evaluate):
    texts = random_texts(120) + ["", "of the", "One. Two."]
    rows = [(t,) for t in texts]
    assert evaluate(T.keywords(F.col("v")), rows) == [
        ", ".join(w for w, _ in keywords_by_hand(t)) or "N/A" for t in texts]
    assert evaluate(T.summary(F.col("v")), rows) == [summary_by_hand(t) for t in texts]
