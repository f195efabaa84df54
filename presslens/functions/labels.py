"""Sentiment labels, the scorer switch and the score badge."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from presslens.functions.text import let

NEUTRAL_BOUND = 0.05

_PREFIX = {"vader": "vader", "textblob": "tb"}


def score_column(scorer: str = "vader") -> str:
    return f"{_PREFIX[scorer]}_compound"


def label_column(scorer: str = "vader") -> str:
    return f"{_PREFIX[scorer]}_label"


def sentiment_label(score: Column, bound: float = NEUTRAL_BOUND) -> Column:
    """Strict bounds: a score of exactly ``bound`` or ``-bound`` is neutral."""
    return (
        F.when(score > F.lit(float(bound)), F.lit("positive"))
        .when(score < F.lit(-float(bound)), F.lit("negative"))
        .otherwise(F.lit("neutral"))
    )


def three_digits(score: Column) -> Column:
    """A score from -4 to 4 with three digits, rounded from its binary value.

    The value times a power of two is a whole number, so what is above a digit, at a
    tie or below is compared exactly; ties go to the even digit. The sign stays, also
    on a rounded zero.
    """
    size = F.abs(score)
    small = size < 2.0 ** -8
    bits = F.when(small, F.lit(70)).otherwise(F.lit(60))
    one = F.when(small, F.lit(Decimal(2 ** 70)).cast("decimal(24,0)")).otherwise(F.lit(Decimal(2 ** 60)).cast("decimal(24,0)"))
    scaled = (size * F.pow(F.lit(2.0), bits)).cast("bigint").cast("decimal(19,0)") * 1000

    def text(x: Column) -> Column:
        rest = x["scaled"] % x["one"]
        whole = ((x["scaled"] - rest) / x["one"]).cast("bigint")
        above = (rest * 2 > x["one"]) | ((rest * 2 == x["one"]) & (whole % 2 == 1))
        n = whole + F.when(above, 1).otherwise(0)
        return F.concat((n / 1000).cast("bigint").cast("string"), F.lit("."), F.lpad((n % 1000).cast("string"), 3, "0"))

    sign = F.when(score.cast("string").startswith("-"), "-").otherwise("")
    return F.concat(sign, let(F.struct(scaled.alias("scaled"), one.alias("one")), text))


def score_badge(score: Column) -> Column:
    """Struct of badge class and signed three-digit text, bound fixed at 0.05."""
    cls = (
        F.when(score > NEUTRAL_BOUND, "score-pos")
        .when(score < -NEUTRAL_BOUND, "score-neg")
        .otherwise("score-neu")
    )
    sign = F.when(score > NEUTRAL_BOUND, "+").otherwise("")
    text = F.concat(sign, three_digits(score))
    return F.struct(cls.alias("badge_class"), text.alias("badge_text"))
