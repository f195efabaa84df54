import random
from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import functions as F

from presslens.functions.labels import score_badge, sentiment_label
from presslens.functions.numbers import half_even_ratio, percent, thousands


def by_hand(num, den, digits):
    if den == 0:
        return None
    quotient = Decimal(num) * 10 ** digits / Decimal(den)
    whole = quotient.to_integral_value(ROUND_HALF_EVEN)
    return float(whole) / 10 ** digits


def test_half_even_ties(evaluate):
    rows = [(1333, 2000), (2, 3), (1, 3), (0, 5), (5, 0)]
    got = evaluate(percent(F.col("a"), F.col("b")), rows, "a bigint, b bigint")
    assert got == [66.6, 66.7, 33.3, 0.0, None]
    assert evaluate(half_even_ratio(F.col("a"), F.col("b"), 3), [(5, 10000), (15, 10000)],
                    "a bigint, b bigint") == [0.0, 0.002]


def test_half_even_by_brute_force(evaluate):
    rng = random.Random(3)
    rows = [(rng.randrange(-10**6, 10**6), rng.randrange(0, 4000)) for _ in range(2000)]
    rows += [(rng.randrange(-10**15, 10**15), rng.randrange(10**11, 10**13)) for _ in range(500)]
    for digits in (0, 1, 4):
        got = evaluate(half_even_ratio(F.col("a"), F.col("b"), digits), rows, "a bigint, b bigint")
        assert got == [by_hand(a, b, digits) for a, b in rows]


def test_label_bounds_are_strict(evaluate):
    rows = [(-0.0501,), (-0.05,), (0.0,), (0.05,), (0.0501,)]
    n, u, p = "negative", "neutral", "positive"
    for bound, expected in [(0.05, [n, u, u, u, p]), (0.0, [n, n, u, p, p]), (0.3, [u] * 5)]:
        assert evaluate(sentiment_label(F.col("v"), bound), rows, "v double") == expected


def test_badge(evaluate):
    got = evaluate(score_badge(F.col("v")), [(0.4321,), (-0.4321,), (0.05,)], "v double")
    assert [tuple(r) for r in got] == [
        ("score-pos", "+0.432"), ("score-neg", "-0.432"), ("score-neu", "0.050")]


def test_thousands(evaluate):
    assert evaluate(thousands(F.col("v")), [(1234567,), (0,)], "v bigint") == ["1,234,567", "0"]
