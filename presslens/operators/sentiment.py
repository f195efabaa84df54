"""Lexicon sentiment scoring.

Two scorers read the same snippet of an article:

* a rule-based one: token valences, moved by boosters and turned by negators up
  to three tokens before, summed and squashed to [-1, 1] by ``s / sqrt(s² + 15)``
  (Hutto & Gilbert 2014);
* the mean polarity and subjectivity of the tokens found, a negator just before
  a token turning its polarity by -0.5.

Weights are whole micro-units, so sums do not depend on row order; the only
floating-point step is the last division.

A literal lexicon, of checked size, becomes hash buckets and scoring is a
projection: no shuffle and no join at any number of articles. A joined lexicon
meets the exploded tokens, salted because common words are hot keys.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presslens import schemas
from presslens.functions.labels import sentiment_label
from presslens.functions.numbers import half_even_ratio
from presslens.functions.once import with_once
from presslens.functions.text import all_matches, scoring_snippet
from presslens.session import written

TOKEN_RE = r"[\p{L}\p{M}']+"

MICRO = 1_000_000
UNIT = 100 * MICRO  # sums are held in 1/100 micro-units
BOOST_PERCENT = (100, 95, 90)  # by distance to the scored token
NEGATION_PERCENT = -74
SQUASH = 15.0

MAX_LITERAL_TOKENS = 10_000
JOIN_SALTS = 16

_ENTRY = "struct<valence: bigint, polarity: bigint, subjectivity: bigint>"
_MODIFIER = "struct<boost: bigint, negates: boolean>"

Lookup = Callable[[str], str]  # SQL of a token to SQL of its weights


def _literal_lookup(rows: list[dict], value_type: str) -> Lookup:
    """Token lookup in a literal array of small maps.

    Reading a map takes time in its length, so tokens are spread over buckets of
    about one entry each. The hash of each row's token was computed by Spark.
    """
    n_buckets = 1 << max(len(rows), 1).bit_length()
    buckets: list[dict] = [{} for _ in range(n_buckets)]
    for row in rows:
        buckets[row["hash"] % n_buckets][row["token"]] = row["value"].asDict()
    text = json.dumps(buckets).replace("\\", "\\\\").replace("'", "\\'")
    table = f"from_json('{text}', 'array<map<string, {value_type}>>')"
    return lambda token: (
        f"try_element_at(get({table}, cast(pmod(xxhash64({token}), {n_buckets}) AS int)), {token})"
    )


def _small_lookup(table: DataFrame, value: Column, value_type: str) -> Lookup:
    """Lookup for a table of at most ``MAX_LITERAL_TOKENS`` rows; a larger one is an error."""
    keyed = table.select("token", value.alias("value"), F.xxhash64("token").alias("hash"))
    rows = keyed.limit(MAX_LITERAL_TOKENS + 1).collect()
    if len(rows) > MAX_LITERAL_TOKENS:
        raise ValueError(f"more than {MAX_LITERAL_TOKENS} tokens; use a joined lexicon")
    return _literal_lookup([row.asDict() for row in rows], value_type)


def _unique(table: DataFrame) -> DataFrame:
    """The table, if every row has a token of its own."""
    odd = table.groupBy("token").agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col("token").isNull())
    found = odd.select("token").first()
    if found is not None:
        raise ValueError(f"token {found['token']!r} is listed twice" if found["token"] else "a token is missing")
    return table


@dataclass(frozen=True)
class Lexicon:
    """Token weights for both scorers, and how to reach them.

    ``lookup`` and ``modifier`` are None when the lexicon is to be joined.
    """

    entries: DataFrame
    modifiers: DataFrame
    lookup: Lookup | None
    modifier: Lookup | None

    @classmethod
    def of(
        cls,
        valences: DataFrame,
        polarities: DataFrame,
        modifiers: DataFrame,
        joined: bool = False,
    ) -> Lexicon:
        """From ``(token, valence)``, ``(token, polarity, subjectivity)`` and
        ``(token, boost, negates)``; weights in micro-units, tokens unique.

        The caller chooses: a literal lexicon makes scoring a projection and holds
        ``MAX_LITERAL_TOKENS`` tokens of each kind at most; a joined one holds any
        number. Both give equal rows.
        """
        entries = _unique(valences).join(_unique(polarities), "token", "full").select(
            "token", "valence", "polarity", "subjectivity"
        )
        modifiers = _unique(modifiers).select("token", "boost", "negates")
        if joined:
            return cls(entries, modifiers, None, None)
        return cls(
            entries, modifiers,
            _small_lookup(entries, F.struct("valence", "polarity", "subjectivity"), _ENTRY),
            _small_lookup(modifiers, F.struct("boost", "negates"), _MODIFIER),
        )


def snippet_tokens() -> Column:
    snippet = scoring_snippet(F.col("title"), F.col("text"))
    return all_matches(F.lower(snippet), TOKEN_RE)


_SUMS = (
    "total", "positive", "negative", "n_signed",
    "half_polarity", "subjectivity", "matched",
)


def _weights(entry: str, modifiers: str) -> str:
    """SQL struct: what a found token weighs, given the modifiers of the three
    tokens before it, nearest first."""
    boost = " + ".join(
        f"coalesce({modifiers}[{i}].boost, 0L) * {p}" for i, p in enumerate(BOOST_PERCENT)
    )
    negated = " OR ".join(f"coalesce({modifiers}[{i}].negates, false)" for i in range(3))
    plain = (
        f"({entry}.valence * 100 + cast(signum({entry}.valence) AS bigint) * ({boost}))"
    )
    return f"""named_struct(
        'valence', coalesce(
            CASE WHEN {negated} THEN {plain} * ({NEGATION_PERCENT}) div 100 ELSE {plain} END, 0L),
        'half_polarity', coalesce(
            {entry}.polarity * CASE WHEN coalesce({modifiers}[0].negates, false)
                               THEN -1L ELSE 2L END, 0L),
        'subjectivity', coalesce({entry}.subjectivity, 0L),
        'matched', CASE WHEN {entry}.polarity IS NOT NULL THEN 1L ELSE 0L END)"""


def _contribution(w: str) -> dict[str, str]:
    """SQL of what a token's weights add to each sum."""
    return {
        "total": f"{w}.valence",
        "positive": f"CASE WHEN {w}.valence > 0 THEN {w}.valence + {UNIT}L ELSE 0L END",
        "negative": f"CASE WHEN {w}.valence < 0 THEN {UNIT}L - {w}.valence ELSE 0L END",
        "n_signed": f"CASE WHEN {w}.valence <> 0 THEN 1L ELSE 0L END",
        "half_polarity": f"{w}.half_polarity",
        "subjectivity": f"{w}.subjectivity",
        "matched": f"{w}.matched",
    }


def _row_sums(words: str, lexicon: Lexicon) -> str:
    """SQL struct of one article's sums, from its array of tokens, in its row."""
    hits = f"""filter(
        transform({words}, (t, i) -> named_struct('i', i, 'entry', {lexicon.lookup('t')})),
        h -> h.entry IS NOT NULL)"""
    known = f"""transform({hits}, h -> named_struct(
        'entry', h.entry,
        'before', transform(array(1, 2, 3), d -> {lexicon.modifier(f'get({words}, h.i - d)')})))"""
    weights = f"transform({known}, k -> {_weights('k.entry', 'k.before')})"
    zeros = ", ".join(f"'{n}', 0L" for n in _SUMS)
    added = ", ".join(f"'{n}', acc.{n} + {c}" for n, c in _contribution("w").items())
    return f"""aggregate({weights},
        named_struct('n_tokens', cast(size({words}) AS bigint), {zeros}),
        (acc, w) -> named_struct('n_tokens', acc.n_tokens, {added}))"""


def _joined_sums(keyed: DataFrame, lexicon: Lexicon, salts: int) -> DataFrame:
    """Sums per ``_row`` by joining exploded tokens with a lexicon of any size.

    The text is read once: each token carries the three before it, and every article
    also gives one row without a token, so that those without a found one keep a
    score. Token rows are salted and the lexicon repeated per salt. Modifiers are
    joined to the tokens found, which are few. Partial aggregation leaves about one
    row per article and task to shuffle.
    """
    tokens = keyed.select("_row", snippet_tokens().alias("words"))
    occurrences = tokens.select("_row", F.expr("""explode(concat(
        array(named_struct('i', -1, 'token', cast(null AS string), 'before', cast(array() AS array<string>),
                           'n_tokens', cast(size(words) AS bigint))),
        transform(words, (t, i) -> named_struct('i', i, 'token', t,
            'before', transform(array(1, 2, 3), d -> get(words, i - d)), 'n_tokens', 0L))))""").alias("o")).select(
        "_row", "o.token", "o.before", "o.n_tokens",
        F.expr(f"cast(pmod(xxhash64(_row, o.i), {salts}) AS int)").alias("salt"),
    )
    entries = lexicon.entries.select(
        "token", F.struct("valence", "polarity", "subjectivity").alias("entry"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
    )
    hits = occurrences.join(entries, ["token", "salt"], "left").where(F.col("entry").isNotNull() | F.col("token").isNull())
    for d in range(3):
        named = lexicon.modifiers.select(F.col("token").alias(f"_t{d}"), F.struct("boost", "negates").alias(f"_m{d}"))
        hits = hits.withColumn(f"_b{d}", F.get("before", F.lit(d))).join(named, F.col(f"_b{d}") == F.col(f"_t{d}"), "left")
    parts = hits.select("_row", "n_tokens", F.col("entry"), F.array("_m0", "_m1", "_m2").alias("before")).select(
        "_row", "n_tokens", F.expr(_weights("entry", "before")).alias("w"))
    added = [F.expr(c).alias(n) for n, c in _contribution("w").items()]
    return parts.select("_row", "n_tokens", *added).groupBy("_row").agg(
        *[F.sum(n).alias(n) for n in ("n_tokens", *_SUMS)])


def _scores(sums: Callable[[str], Column]) -> dict[str, Column]:
    """The eight score columns from the sums of an article."""
    total = sums("total").cast("double") / float(UNIT)
    compound = F.when(sums("total") == 0, F.lit(0.0)).otherwise(
        total / F.sqrt(total * total + SQUASH)
    )
    unsigned = (sums("n_tokens") - sums("n_signed")) * F.lit(UNIT)
    whole = sums("positive") + sums("negative") + unsigned

    def share(part: Column) -> Column:
        return F.coalesce(half_even_ratio(part, whole, 4), F.lit(0.0))

    polarity = F.coalesce(
        half_even_ratio(sums("half_polarity"), sums("matched") * (2 * MICRO), 4), F.lit(0.0)
    )
    return {
        "vader_compound": F.coalesce(F.bround(compound, 4), F.lit(0.0)),
        "vader_label": sentiment_label(compound),
        "vader_pos": share(sums("positive")),
        "vader_neu": share(unsigned),
        "vader_neg": share(sums("negative")),
        "tb_compound": polarity,
        "tb_label": sentiment_label(polarity),
        "tb_subjectivity": F.coalesce(
            half_even_ratio(sums("subjectivity"), sums("matched") * MICRO, 4), F.lit(0.0)
        ),
    }


def score_articles(articles: DataFrame, lexicon: Lexicon, salts: int = JOIN_SALTS) -> DataFrame:
    """Articles ``(title, text, ...)`` with the eight score columns added, row by row:
    null and repeated ids make no difference."""
    articles = articles.drop(*schemas.SENTIMENT_TYPES)
    if lexicon.lookup is not None:
        words = with_once(articles, "_words", snippet_tokens())
        summed = with_once(words, "_sums", F.expr(_row_sums("_words", lexicon)))
        return summed.withColumns(_scores(lambda n: F.col(f"_sums.{n}"))).drop("_words", "_sums")
    keyed = written(articles.withColumn("_row", F.monotonically_increasing_id()), "keyed")
    scores = _joined_sums(keyed, lexicon, salts).withColumns(_scores(F.col))
    return keyed.join(scores.select("_row", *schemas.SENTIMENT_TYPES), "_row").drop("_row")


def score_rows(articles: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Rows for the scores table: the id and the eight score columns."""
    return score_articles(articles.select("id", "title", "text"), lexicon).select(
        *schemas.SCORES.fieldNames()
    )


def score_compound(articles: DataFrame, lexicon: Lexicon) -> DataFrame:
    """First scorer alone."""
    return score_rows(articles, lexicon).select(
        "id", "vader_compound", "vader_label", "vader_pos", "vader_neu", "vader_neg"
    )


def score_polarity(articles: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Second scorer alone."""
    return score_rows(articles, lexicon).select(
        "id", "tb_compound", "tb_label", "tb_subjectivity"
    )


def score_with(articles: DataFrame, scorer: Callable[[Column], Column], name: str) -> DataFrame:
    """Hook for a scorer of your own, e.g. a pandas UDF from snippet to score."""
    snippet = scoring_snippet(F.col("title"), F.col("text"))
    return articles.withColumn(name, F.bround(scorer(snippet), 4))
