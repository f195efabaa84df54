import random

from presslens.operators import views
from presslens.plans.dashboard import selected_view

COLUMNS = ("id bigint, title string, url string, source string, date string, "
           "vader_compound double, vader_label string, tb_compound double, tb_label string, "
           "tb_subjectivity double")


def label(x, bound=0.05):
    return "positive" if x > bound else "negative" if x < -bound else "neutral"


def table(spark, rows):
    return spark.createDataFrame(
        [(i, t, f"u{i}", s, None, v, label(v), b, label(b), 0.5) for i, (t, s, v, b) in enumerate(rows)], COLUMNS)


def some(spark, n=200, seed=5):
    rng = random.Random(seed)
    scores = [-0.5, -0.0501, -0.05, 0.0, 0.05, 0.0501, 0.1, 0.9]
    rows = [("rain storm and the city", rng.choice(["a", "a", "a", "b", "N/A", "c"]),
             rng.choice(scores), rng.choice(scores)) for _ in range(n)]
    return rows, table(spark, rows)


def test_agreement(spark):
    def rate(*pairs):
        return views.agreement_rate(table(spark, [("t", "s", a, b) for a, b in pairs])).first()[0]

    assert rate((1.0, 1.0), (0.0, 0.0), (-1.0, -1.0)) == 100.0
    assert rate((1.0, 1.0), (0.0, -1.0), (-1.0, -1.0)) == 66.7
    assert rate((1.0, -1.0), (1.0, -1.0)) == 0.0
    assert rate() == 0.0


def test_kpis_by_brute_force(spark):
    rows, df = some(spark)
    for bound in (0.0, 0.05, 0.3):
        got = views.kpi_strip(views.relabel(df, bound)).first()
        labels = [(label(v, bound), label(b, bound)) for _, _, v, b in rows]
        n = len(rows)
        assert got["articles"] == n and got["sources"] == len({r[1] for r in rows})
        assert got["positive_pct"] == round(sum(a == "positive" for a, _ in labels) / n * 100, 1)
        assert got["agreement_pct"] == round(sum(a == b for a, b in labels) / n * 100, 1)
    empty = views.kpi_strip(df.limit(0)).first()
    assert tuple(empty) == (0, 0, None, None, 0.0)


def test_shares_sum_to_one_hundred(spark):
    rows, df = some(spark)
    got = views.label_distribution(df).collect()
    for scorer in ("vader", "textblob"):
        assert sum(r["n"] for r in got if r["scorer"] == scorer) == len(rows)
        assert abs(sum(r["share_pct"] for r in got if r["scorer"] == scorer) - 100) < 0.2


def test_headlines_break_ties_by_id(spark):
    df = table(spark, [("t", "s", v, 0.0) for v in (0.5, 0.9, 0.9, -0.3, -0.8, 0.01, 0.02)])
    ids = lambda label, n=2: [r["id"] for r in views.top_headlines(df, label, n).collect()]
    assert ids("positive") == [1, 2] and ids("negative") == [4, 3] and ids("neutral") == [6, 5]
    assert views.top_headlines(df, "positive", scorer="textblob").isEmpty()
    both = views.top_headlines_both(df, 1).collect()
    assert {(r["label"], r["id"], r["rank"]) for r in both} == {("positive", 1, 1), ("negative", 4, 1)}


def test_source_selection(spark):
    rows, df = some(spark)
    count = lambda s: sum(r[1] == s for r in rows)
    names = [r["source"] for r in views.eligible_sources(df, 40).collect()]
    assert names == sorted(s for s in "abc" if count(s) >= 40)
    assert views.filter_sources(df, []).count() == len(rows)
    assert views.filter_sources(df, ["b"]).count() == count("b")
    assert selected_view(df, selected=[]).count() == len(rows)
    assert selected_view(df, min_articles=1).count() == len(rows) - count("N/A")
    assert selected_view(df, min_articles=40).count() == sum(map(count, names))
    assert selected_view(df, min_articles=10_000).count() == len(rows)  # none eligible: no filter


def test_means_and_bar_label(spark):
    df = table(spark, [("t", "x", 0.0005, 0.0), ("t", "x", 0.0005, 0.1), ("t", "y", -0.0504, 0.0)])
    got = {r["source"]: (r["vader_mean"], r["tb_mean"], r["bar_label"]) for r in views.sentiment_by_source(df).collect()}
    assert got == {"x": (0.0, 0.05, "neutral"), "y": (-0.05, 0.0, "neutral")}


def test_terms(spark):
    df = table(spark, [("Rain and RAIN in it", "s", 0.9, 0.0), ("Rain city", "s", 0.9, 0.0), ("storm", "s", 0.0, 0.0)])
    got = [tuple(r) for r in views.term_frequency(df, "positive").collect()]
    assert got == [("rain", 3, 1.0), ("city", 1, 1 / 3)]
    words = views.word_text(df, "positive", articles_per_part=1).orderBy("part").collect()
    assert [r["words"] for r in words] == ["rain rain", "rain city"]
    whole = views.word_text(df, "positive").collect()
    assert [r["words"] for r in whole] == ["rain rain rain city"]


def test_scatter_bins_hold_every_article(spark):
    rows, df = some(spark)
    bins = views.scorer_scatter_bins(df).collect()
    assert sum(r["n"] for r in bins) == len(rows) == views.scorer_scatter(df).count()
    assert all(0 <= r["vader_bin"] <= 19 for r in bins)


def test_raw_rows_are_sorted(spark):
    _, df = some(spark)
    got = [(r["tb_compound"], r["id"]) for r in views.raw_scored(df, "textblob").collect()]
    assert got == sorted(got)


def test_approximate_sources_and_sketches_per_batch(spark):
    from pyspark.sql import functions as F

    rows = spark.range(60_000).select(
        (F.col("id") % 20_000).cast("string").alias("source"), F.lit("positive").alias("vader_label"),
        F.lit("positive").alias("tb_label"), (F.col("id") % 3).alias("batch"))
    exact = views.kpi_strip(rows).first()
    near = views.kpi_strip(rows, approximate=True).first()
    assert exact["sources"] == 20_000
    assert abs(near["sources"] - 20_000) <= 0.05 * 20_000
    assert {k: v for k, v in exact.asDict().items() if k != "sources"} == {k: v for k, v in near.asDict().items() if k != "sources"}
    sketches = None
    for b in range(3):
        one = views.source_sketch(rows.where(F.col("batch") == b))
        sketches = one if sketches is None else sketches.unionByName(one)
    assert views.sources_of_sketches(sketches).first()["sources"] == near["sources"]
    assert views.kpi_strip(rows.limit(0), approximate=True).first()["sources"] == 0


def test_top_headlines_in_two_steps_for_a_large_n(spark):
    from pyspark.sql import functions as F

    rows = spark.range(40_000).select(
        "id", F.lit("t").alias("title"), F.lit("s").alias("source"), F.lit("u").alias("url"), F.lit("d").alias("date"),
        F.when(F.col("id") % 3 == 0, "negative").otherwise("positive").alias("vader_label"),
        ((F.col("id") * 7919 % 1000) / 1000.0 - 0.5).alias("vader_compound")).repartition(12)
    n = 5000
    two = views.top_headlines_both(rows, n)
    plan = two._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") >= 2 or plan.count("Window") >= 2
    got = sorted(tuple(r) for r in two.collect())
    views_one = views.TWO_STEP_FROM
    try:
        views.TWO_STEP_FROM = n + 1
        one = sorted(tuple(r) for r in views.top_headlines_both(rows, n).collect())
    finally:
        views.TWO_STEP_FROM = views_one
    assert got == one and len(got) == 2 * n
    # the final ranking of a label reads at most HEADLINE_SALTS * n rows
    first = (rows.where(F.col("vader_label") == "positive")
             .withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(views.HEADLINE_SALTS)))
             .groupBy("_salt").count().collect())
    assert sum(min(r["count"], n) for r in first) <= views.HEADLINE_SALTS * n
