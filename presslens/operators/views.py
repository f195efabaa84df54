"""Analyst views over scored articles.

Each is ``DataFrame -> DataFrame`` and takes what a reader may choose: scorer,
neutral bound, sources, minimum articles, number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presslens.functions.labels import (
    label_column, score_badge, score_column, sentiment_label,
)
from presslens.functions.numbers import mean_of_scores, percent
from presslens.functions.text import not_stopword, title_tokens, title_words
from presslens.schemas import MISSING
from presslens.session import written


def relabel(scored: DataFrame, bound: float) -> DataFrame:
    """Both labels again, from the stored scores, at another neutral bound."""
    return scored.withColumns({
        "vader_label": sentiment_label(F.col("vader_compound"), bound),
        "tb_label": sentiment_label(F.col("tb_compound"), bound),
    })


def _enough_articles(scored: DataFrame, min_articles: int) -> DataFrame:
    return (
        scored.where(F.col("source") != MISSING)
        .groupBy("source")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_articles)
    )


def eligible_sources(scored: DataFrame, min_articles: int = 1) -> DataFrame:
    """Sources with enough articles, by name; ``N/A`` never is one."""
    return _enough_articles(scored, min_articles).orderBy("source")


def filter_sources(scored: DataFrame, selected: Sequence[str]) -> DataFrame:
    """Rows of the selected sources; an empty selection means no filter."""
    return scored.where(F.col("source").isin(*selected)) if selected else scored


def filter_eligible(scored: DataFrame, min_articles: int = 1) -> DataFrame:
    """Rows of all eligible sources, the selection a reader starts with.

    With a minimum of one every named source is eligible: a plain predicate.
    Above that, the source list is written first. Spark then knows its size and
    broadcasts it when that allows, so articles are not shuffled by source; for a
    longer list AQE splits a hot source. Without any eligible source the
    selection is empty, which means no filter.
    """
    if min_articles <= 1:
        named = scored.where(F.col("source") != MISSING)
        return scored if named.select("source").isEmpty() else named
    enough = written(_enough_articles(scored, min_articles).select("source"), "sources")
    if enough.isEmpty():
        return scored
    return scored.join(enough, "source", "left_semi").select(scored.columns)


#: Registers of the approximate distinct count, as a power of two: 2^12 registers give
#: a relative standard error of about 1.6 %.
SKETCH_BITS = 12


def source_sketch(scored: DataFrame) -> DataFrame:
    """One row, ``sources_sketch``: a mergeable HyperLogLog sketch of the non-null
    sources of these rows. Kept per batch, sketches of batches are unioned later."""
    return scored.agg(F.hll_sketch_agg("source", SKETCH_BITS).alias("sources_sketch"))


def sources_of_sketches(sketches: DataFrame) -> DataFrame:
    """One row, ``sources``: the distinct count estimated from the union of sketches."""
    return sketches.agg(F.hll_sketch_estimate(F.hll_union_agg("sources_sketch")).alias("sources"))


def kpi_strip(scored: DataFrame, scorer: str = "vader", approximate: bool = False) -> DataFrame:
    """One row: articles, sources, percent positive and negative, agreement.

    ``approximate``: sources are counted by a HyperLogLog sketch (``SKETCH_BITS``), in
    fixed memory a task and without shuffling the distinct values; else exactly.
    """
    label = F.col(label_column(scorer))
    n = F.count("*")
    sources = (F.hll_sketch_estimate(F.hll_sketch_agg("source", SKETCH_BITS)) if approximate
               else F.countDistinct("source"))
    return scored.agg(
        n.alias("articles"),
        sources.alias("sources"),
        percent(F.count_if(label == "positive"), n).alias("positive_pct"),
        percent(F.count_if(label == "negative"), n).alias("negative_pct"),
        _agreement().alias("agreement_pct"),
    )


def _agreement():
    agreed = F.count_if(F.col("vader_label") == F.col("tb_label"))
    return F.coalesce(percent(agreed, F.count("*")), F.lit(0.0))


def agreement_rate(scored: DataFrame) -> DataFrame:
    """Percent of articles with the same label from both scorers; 0.0 for none."""
    return scored.agg(_agreement().alias("agreement_pct"))


def label_distribution(scored: DataFrame) -> DataFrame:
    """Count and share of each label, for both scorers.

    Rows are counted by label pair first; only those few counts are unfolded.
    """
    pairs = scored.groupBy("vader_label", "tb_label").agg(F.count("*").alias("n"))
    counted = (
        pairs.select("n", F.explode(F.array(
            F.struct(F.lit("vader").alias("scorer"), F.col("vader_label").alias("label")),
            F.struct(F.lit("textblob").alias("scorer"), F.col("tb_label").alias("label")),
        )).alias("x"))
        .groupBy("x.scorer", "x.label")
        .agg(F.sum("n").alias("n"))
    )
    of_scorer = F.sum("n").over(Window.partitionBy("scorer"))
    return counted.withColumn("share_pct", percent(F.col("n"), of_scorer))


def scorer_scatter(scored: DataFrame, scorer: str = "vader") -> DataFrame:
    """Both scores of every article, with the active label."""
    return scored.select(
        "id", "title", "source", "vader_compound", "tb_compound",
        F.col(label_column(scorer)).alias("label"),
    )


def scorer_scatter_bins(scored: DataFrame, scorer: str = "vader", bins: int = 20) -> DataFrame:
    """The scatter as counts on a grid over [-1, 1]², for more articles than dots."""

    def cell(score: str):
        return F.least(
            F.floor((F.col(score) + 1) * (bins / 2)), F.lit(bins - 1)
        ).cast("bigint")

    return scored.groupBy(
        cell("vader_compound").alias("vader_bin"), cell("tb_compound").alias("tb_bin"),
        F.col(label_column(scorer)).alias("label"),
    ).agg(F.count("*").alias("n"))


def sentiment_by_source(scored: DataFrame) -> DataFrame:
    """Mean scores per source, lowest first; the bar label uses the fixed bound."""
    return (
        scored.groupBy("source")
        .agg(
            mean_of_scores(F.col("vader_compound")).alias("vader_mean"),
            mean_of_scores(F.col("tb_compound")).alias("tb_mean"),
        )
        .withColumn("bar_label", sentiment_label(F.col("vader_mean")))
        .orderBy("vader_mean", "source")
    )


def top_headlines(
    scored: DataFrame, label: str, n: int = 10, scorer: str = "vader"
) -> DataFrame:
    """The ``n`` most extreme headlines of a label; lowest first only if negative."""
    score = F.col(score_column(scorer))
    direction = score.asc() if label == "negative" else score.desc()
    return (
        scored.where(F.col(label_column(scorer)) == label)
        .orderBy(direction, "id")
        .limit(n)
        .select("id", "title", "source", "url", "date", score.alias("score"))
    )


#: Sub-groups of a label for a large ``n``: each keeps its ``n`` best, the label then
#: ranks at most ``HEADLINE_SALTS * n`` rows in one task.
HEADLINE_SALTS = 16
#: From this ``n`` on, top headlines are cut in two steps.
TWO_STEP_FROM = 1000


def top_headlines_both(
    scored: DataFrame, n: int = 10, scorer: str = "vader",
    labels: Sequence[str] = ("positive", "negative"),
) -> DataFrame:
    """Top headlines of several labels in one pass, ranked within each.

    The rank filter runs in every task before the shuffle, so at most ``n`` rows
    per label and task are moved. For ``n`` of ``TWO_STEP_FROM`` or more, rows are
    first ranked within ``HEADLINE_SALTS`` sub-groups of a label (by a hash of the
    id), each cut to ``n``, and then within the label: the last task's input is at
    most ``HEADLINE_SALTS * n`` rows, whatever the number of tasks before it. Both
    ways give the same rows (ties go to the smaller id).
    """
    label, score = F.col(label_column(scorer)), F.col(score_column(scorer))
    extreme = F.when(label == "negative", score).otherwise(-score)
    rows = scored.where(label.isin(*labels)).select(
        label.alias("label"), "id", "title", "source", "url", "date",
        score.alias("score"), extreme.alias("_extreme"),
    )
    if n >= TWO_STEP_FROM:
        rows = (
            rows.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(HEADLINE_SALTS)))
            .withColumn("_first", F.row_number().over(Window.partitionBy("label", "_salt").orderBy("_extreme", "id")))
            .where(F.col("_first") <= n).drop("_salt", "_first")
        )
    return (
        rows.withColumn("rank", F.row_number().over(
            Window.partitionBy("label").orderBy("_extreme", "id")))
        .where(F.col("rank") <= n)
        .drop("_extreme")
    )


def term_frequency(
    scored: DataFrame, label: str, top: int = 70, scorer: str = "vader"
) -> DataFrame:
    """Most frequent title words of a label, with weight relative to the first."""
    words = scored.where(F.col(label_column(scorer)) == label).select(
        F.explode(title_words(F.col("title"))).alias("term")
    )
    ranked = (
        words.where(not_stopword(F.col("term")))
        .groupBy("term")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "term")
        .limit(top)
    )
    most = F.max("n").over(Window.partitionBy())
    return ranked.withColumn("weight", F.col("n") / most)


def word_text(
    scored: DataFrame, label: str, scorer: str = "vader", articles_per_part: int = 1000
) -> DataFrame:
    """Title words of a label as text, per source and in parts.

    A part covers a fixed range of article ids, so it stays small even for a
    source that holds most articles; the parts in order are the whole text.
    """
    part = F.call_function("div", F.col("id"), F.lit(articles_per_part).cast("bigint"))
    rows = (
        scored.where(F.col(label_column(scorer)) == label)
        .select(
            "source", part.alias("part"), "id",
            F.array_join(title_tokens(F.coalesce("title", F.lit(""))), " ").alias("words"),
        )
        .where(F.col("words") != "")
    )
    in_order = F.sort_array(F.collect_list(F.struct("id", "words")))
    return rows.groupBy("source", "part").agg(
        F.count("*").alias("titles"),
        F.array_join(F.transform(in_order, lambda r: r["words"]), " ").alias("words"),
    )


def raw_scored(scored: DataFrame, scorer: str = "vader") -> DataFrame:
    """The scored rows for browsing, lowest active score first."""
    return scored.orderBy(score_column(scorer), "id").select(
        "id", "title", "source", "date", "vader_compound", "vader_label",
        "tb_compound", "tb_label", "tb_subjectivity",
    )


def with_badges(scored: DataFrame, scorer: str = "vader") -> DataFrame:
    """Score badge (class and text) of each article."""
    return scored.select("id", score_badge(F.col(score_column(scorer))).alias("b")).select(
        "id", "b.*"
    )
