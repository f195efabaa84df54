"""Registered queries: ``(spark, sf_dir) -> DataFrame`` by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import inputs
from presslens import schemas
from presslens.functions import text as T
from presslens.functions import urls as U
from presslens.functions.dates import parse_date
from presslens.functions.numbers import thousands
from presslens.operators import csv_export, dead_letters, dedupe, discover, extract, report, sentiment, store, views
from presslens.plans.dashboard import scored_view, selected_view
from presslens.plans import schedule
from presslens.plans.run import run_batch, score_new
from presslens.session import shared_folder, written
from presslens.sources import articles as article_source
from presslens.sources import feeds as feed_source
from presslens.sources import sitemaps as sitemap_source
from presslens.streaming import incremental

BOUND = 0.1
MIN_ARTICLES = 40


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return scored_view(inputs.articles(spark, d, costly=True), inputs.lexicon(spark))


def _view(spark: SparkSession, d: str) -> DataFrame:
    scored = scored_view(
        inputs.articles(spark, d, costly=True), inputs.lexicon(spark),
        selected=None, min_articles=MIN_ARTICLES,
    )
    return views.relabel(scored, BOUND)


# Sources


def feed_items(spark, d):
    return feed_source.feed_items(inputs.feeds(spark, d), inputs.MAX_PER_FEED)


def feed_health(spark, d):
    return feed_source.feed_health(inputs.feeds(spark, d), inputs.MAX_PER_FEED)


def sitemap_urls(spark, d):
    parsed = sitemap_source.parse_sitemaps(inputs.sitemaps(spark, d), inputs.MAX_PER_SITE)
    return sitemap_source.walk_sitemaps(
        inputs.site_table(spark, d), written(parsed, "sitemaps"), inputs.MAX_PER_SITE
    )


def sitemap_health(spark, d):
    return sitemap_source.sitemap_health(inputs.sitemaps(spark, d))


def sitemap_guess(spark, d):
    return inputs.site_table(spark, d).select("site", U.sitemap_guess(F.col("site")).alias("sitemap"))


def feed_probe_pick(spark, d):
    sites = inputs.hosts(spark, d).select(
        F.concat(F.lit("https://"), "host", F.lit("/")).alias("site")
    ).distinct()
    return feed_source.probe_pick(sites, inputs.probes(spark, d))


def feed_link_html(spark, d):
    return inputs.homepages(spark, d).select(
        "site", feed_source.feed_link(F.col("html"), F.col("site")).alias("feed_url")
    )


def find_feeds(spark, d):
    return feed_source.find_feeds(inputs.homepages(spark, d), inputs.home_probes(spark, d))


def _sources(spark, d):
    parsed = sitemap_source.parse_sitemaps(inputs.sitemaps(spark, d), inputs.MAX_PER_SITE)
    return inputs.feeds(spark, d), inputs.site_table(spark, d), written(parsed, "sitemaps")


def _raw(spark, d):
    return discover.discovered_raw(*_sources(spark, d), inputs.MAX_PER_SITE)


def discover_all(spark, d):
    return discover.discover_all(*_sources(spark, d), inputs.MAX_PER_SITE)


def discover_counts(spark, d):
    return discover.discover_counts(_raw(spark, d))


def dedupe_keep_first(spark, d):
    ordered = inputs.articles(spark, d).select(F.col("id").alias("pos"), "url")
    return dedupe.keep_first(ordered, "url", "pos")


def load_articles(spark, d):
    scored = sentiment.score_articles(
        inputs.articles(spark, d, costly=True), inputs.lexicon(spark)
    )
    return article_source.load_articles(written(scored.drop("text", "tags"), "scored"))


# Extraction


def _layer(name):
    def query(spark, d):
        return extract.extract_layer(inputs.crawl(spark, d, costly=True), name, inputs.MIN_LEN, inputs.NOW)
    return query


def _tried(spark, d):
    return extract.try_extract(inputs.crawl(spark, d, costly=True), inputs.MIN_LEN, inputs.NOW)


def extract_articles(spark, d):
    return extract.accepted_articles(_tried(spark, d))


def extract_counts(spark, d):
    return extract.extract_counts(_tried(spark, d))


def doc_keywords(spark, d):
    return inputs.table(spark, d, "documents", costly=True).select(
        "doc_id", T.keywords(F.col("text")).alias("keywords")
    )


def doc_summary(spark, d):
    return inputs.table(spark, d, "documents", costly=True).select(
        "doc_id", T.summary(F.col("text")).alias("summary")
    )


# Store


def _batch(spark, d):
    """The batch, some of it without a URL."""
    return inputs.batch(spark, d).withColumn("url", F.when(F.col("id") % 41 != 0, F.col("url")))


def _bucketed(spark, d, batch):
    """The store written in URL buckets, and read for the buckets of the batch alone."""
    given = inputs.store(spark, d)
    path = shared_folder(spark, "bucketed")
    store.write_batch(given, path, "given", 0, by_url=True)
    return store.read_batches(spark, path, given.schema, url_buckets=store.touched_buckets(batch))


def insert_new(spark, d):
    batch = _batch(spark, d)
    return store.insert_new(batch, _bucketed(spark, d, batch))


def insert_counts(spark, d):
    batch = _batch(spark, d)
    return store.insert_counts(batch, _bucketed(spark, d, batch))


def score_unscored(spark, d):
    """Scores put back on a store of which the older part is scored already."""
    saved, lex = inputs.store(spark, d, costly=True), inputs.lexicon(spark)
    older = sentiment.score_articles(
        saved.where(F.col("scraped_at") < inputs.SCORED_DAY), lex
    )
    newer = saved.where(F.col("scraped_at") >= inputs.SCORED_DAY)
    part = older.unionByName(newer, allowMissingColumns=True)
    scores = sentiment.score_rows(store.unscored(part), lex)
    return store.merge_scores(part, scores).select("id", *schemas.SENTIMENT_TYPES)


def backfill_sources(spark, d):
    return store.backfill_sources(inputs.articles(spark, d)).select("id", "source")


def backfill_count(spark, d):
    return store.backfill_count(inputs.articles(spark, d))


def store_table(spark, d):
    """A catalog table over the store folder, the same batch appended twice: the rows SQL reads."""
    path = shared_folder(spark, "table")
    name = "presslens_store_" + path.rsplit("-", 1)[1]
    store.init_store(spark, name, path)
    for batch_id in (0, 1):
        store.append_batch(spark, inputs.articles(spark, d), path, batch_id, table=name)
    return spark.sql(f"SELECT id, url, source, {store.BATCH_COLUMN} FROM {name}")


def repaired_store(spark, d):
    """Articles appended to a store, whose sources are then repaired in place twice:
    the stored rows as read back, and how many each repair changed."""
    path = shared_folder(spark, "repaired")
    store.append_batch(spark, inputs.articles(spark, d), path, 0)
    first = store.repair_sources(spark, path)
    second = store.repair_sources(spark, path)
    return store.read_batches(spark, path, schemas.STORED).select(
        "id", "source", F.lit(first).cast("long").alias("changed_first"), F.lit(second).cast("long").alias("changed_second"),
    )


def ensure_columns(spark, d):
    saved = inputs.articles(spark, d).withColumn("vader_label", F.when(F.col("id") % 2 == 0, "neutral"))
    return store.ensure_columns(saved).select(
        "id", "title", *schemas.SENTIMENT_TYPES
    )


def csv_roundtrip(spark, d):
    path = csv_export.export_csv(
        inputs.articles(spark, d), shared_folder(spark, "csv"), "20250201_080000"
    )
    return csv_export.read_csv(spark, path)


def dead_letters_of_run(spark, d):
    return extract.failed_pages(_tried(spark, d), inputs.NOW)


def dead_letter_retention(spark, d):
    """A log of the sites' pages, and a day later those of the mobile sites."""
    def lines(rows, failed_at):
        return rows.select(
            F.lit(failed_at).alias("failed_at"), F.lit(extract.ALL_FAILED).alias("reason"), "url"
        )

    mobile = F.col("host").startswith("m.")
    crawled = inputs.crawl(spark, d)
    return dead_letters.append_dead_letters(
        lines(crawled.where(~mobile), inputs.DAY_BEFORE), lines(crawled.where(mobile), inputs.NOW),
        inputs.NOW, limit=100,
    )


# Columns


def article_urls(spark, d):
    links = inputs.hosts(spark, d).select("page_id", F.posexplode(F.concat(
        F.array("url"),
        F.transform(
            F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)),
            lambda h: F.concat(F.lit("https://"), "host", h),
        ),
    )).alias("pos", "url"))
    return links.withColumn("is_article", U.is_article_url(F.col("url")))


def url_domain(spark, d):
    return inputs.pages(spark, d).select("page_id", U.url_domain(F.col("url")).alias("domain"))


def clean_source(spark, d):
    return inputs.articles(spark, d).select(
        "id", U.clean_source(F.col("source"), F.col("url")).alias("source")
    )


def title_tokens(spark, d):
    return inputs.articles(spark, d).select(
        "id", F.array_join(T.title_tokens(F.col("title")), " ").alias("tokens")
    )


def snippet(spark, d):
    return inputs.articles(spark, d).select(
        "id", T.scoring_snippet(F.col("title"), F.col("text")).alias("snippet")
    )


def parse_dates(spark, d):
    return inputs.articles(spark, d).select("id", parse_date(F.col("date")).alias("date"))


def join_authors(spark, d):
    """Author lists made of the words of each title's capitals."""
    names = T.all_matches(F.col("title"), "[A-Z][a-z]+")
    return inputs.articles(spark, d).select("id", T.joined_or_missing(names).alias("authors"))


# Scoring


def score_compound(spark, d):
    return sentiment.score_compound(inputs.articles(spark, d, costly=True), inputs.lexicon(spark))


def score_polarity(spark, d):
    return sentiment.score_polarity(inputs.articles(spark, d, costly=True), inputs.lexicon(spark))


def score_articles(spark, d):
    return sentiment.score_rows(inputs.articles(spark, d, costly=True), inputs.lexicon(spark))


def score_articles_joined(spark, d):
    """The same with a joined lexicon."""
    return sentiment.score_rows(inputs.articles(spark, d, costly=True), inputs.lexicon(spark, joined=True))


# Views


def kpi_strip(spark, d):
    return views.kpi_strip(_view(spark, d))


def agreement_rate(spark, d):
    return views.agreement_rate(_scored(spark, d))


def label_distribution(spark, d):
    return views.label_distribution(_view(spark, d))


def relabel(spark, d):
    return views.relabel(_scored(spark, d), BOUND).select(
        "id", "vader_compound", "vader_label", "tb_compound", "tb_label"
    )


def eligible_sources(spark, d):
    return views.eligible_sources(written(_scored(spark, d), "scored"), MIN_ARTICLES)


def filter_sources(spark, d):
    scored = written(_scored(spark, d), "scored")
    return selected_view(scored, min_articles=MIN_ARTICLES).select("id", "source")


def filter_selected(spark, d):
    chosen = ["wire", "src1.example.com", "nobody"]
    return selected_view(_scored(spark, d), selected=chosen).select("id", "source")


def filter_unselected(spark, d):
    return selected_view(_scored(spark, d), selected=[]).select("id", "source")


def sentiment_by_source(spark, d):
    return views.sentiment_by_source(_scored(spark, d))


def _top(label):
    def query(spark, d):
        return views.top_headlines(_scored(spark, d), label)
    return query


def top_headlines_both(spark, d):
    return views.top_headlines_both(
        _scored(spark, d), labels=("positive", "negative", "neutral"), scorer="textblob"
    )


def term_frequency(spark, d):
    return views.term_frequency(_scored(spark, d), "negative")


def word_text_by_source(spark, d):
    return views.word_text(_scored(spark, d), "positive")


def raw_scored(spark, d):
    return views.raw_scored(written(_scored(spark, d), "scored"))


def scorer_scatter(spark, d):
    return views.scorer_scatter(_scored(spark, d))


def scorer_scatter_bins(spark, d):
    return views.scorer_scatter_bins(_scored(spark, d))


def score_badge(spark, d):
    return views.with_badges(_scored(spark, d))


# Reports


def db_stats(spark, d):
    return report.db_stats(inputs.articles(spark, d), inputs.TODAY)


def store_size_text(spark, d):
    """Characters stored by language, with thousands separators."""
    sums = inputs.articles(spark, d).groupBy("language").agg(F.sum(F.length("text")).alias("n"))
    return sums.select("language", thousands(F.col("n")).alias("characters"))


def is_empty_store(spark, d):
    """The first-run check before and after a batch was stored."""
    path = f"{shared_folder(spark, 'first')}/store"
    before = article_source.is_empty_store(spark, path)
    store.append_batch(spark, inputs.articles(spark, d), path, 0)
    after = article_source.is_empty_store(spark, path)
    return spark.createDataFrame([("new", before), ("filled", after)], "store string, empty boolean")


def top_sources(spark, d):
    return report.top_sources(inputs.articles(spark, d))


def top_languages(spark, d):
    return report.top_languages(inputs.articles(spark, d))


def source_bars(spark, d):
    return report.source_bars(inputs.articles(spark, d))


def extractor_breakdown(spark, d):
    return report.extractor_breakdown(extract_articles(spark, d))


def preview(spark, d):
    return report.preview(extract_articles(spark, d))


def run_summary(spark, d):
    known = inputs.crawl(spark, d).where(F.col("host").startswith("blog.")).select("url")
    return run_batch(
        inputs.feeds(spark, d), inputs.site_table(spark, d), inputs.sitemaps(spark, d),
        inputs.crawl(spark, d).select("page_id", "url", "html"), known,
        max_per_source=inputs.MAX_PER_SITE, min_len=inputs.MIN_LEN, now=inputs.NOW,
    ).summary


# Incremental


def _ingested(spark, d):
    """Pages landed in two drops, blogs in both: folders of the store and its dead letters."""
    base = shared_folder(spark, "ingest")
    landed, saved, checkpoint = f"{base}/landed", f"{base}/store", f"{base}/checkpoint"
    crawled = inputs.crawl(spark, d)
    for host_filter in (~F.col("host").startswith("m."), F.col("host").rlike("^(m|blog)[.]")):
        crawled.where(host_filter).select("page_id", "url", "html").write.mode("append").parquet(landed)
        incremental.ingest_pages(
            spark, landed, saved, checkpoint, min_len=inputs.MIN_LEN, scraped_at=inputs.NOW,
            letters=f"{base}/letters",
        )
    return saved, f"{base}/letters"


def stream_ingest(spark, d):
    """The store after the second drop."""
    return store.read_batches(spark, _ingested(spark, d)[0], schemas.STORED).drop("created_at")


def stream_dead_letters(spark, d):
    """The dead letters after the second drop."""
    return store.read_batches(spark, _ingested(spark, d)[1], schemas.DEAD_LETTER)


def mixed_writers(spark, d):
    """A batch run stored as 0, then two streams, each with a checkpoint of its own,
    into the same store and scores: every article, and how many scores it has."""
    base = shared_folder(spark, "mixed")
    landed, saved, scores = (f"{base}/{n}" for n in ("landed", "store", "scores"))
    lex = inputs.lexicon(spark)
    store.append_batch(spark, inputs.store(spark, d), saved, 0)
    score_new(spark, store.read_batches(spark, saved, schemas.STORED), scores, 0, lex)
    crawled = inputs.crawl(spark, d).withColumn("page_id", F.col("page_id") + inputs.PAGE_IDS)
    for n, part in enumerate((~F.col("host").startswith("m."), F.col("host").startswith("m."))):
        crawled.where(part).select("page_id", "url", "html").write.mode("append").parquet(landed)
        incremental.ingest_pages(spark, landed, saved, f"{base}/ingest-{n}", min_len=inputs.MIN_LEN, scraped_at=inputs.NOW)
        incremental.score_store(spark, saved, scores, f"{base}/score-{n}", lex)
    known = store.read_batches(spark, scores, schemas.SCORES).groupBy("id").agg(F.count("*").alias("n_scores"))
    return store.read_batches(spark, saved, schemas.STORED).select("id", "url").join(known, "id", "left")


def _scheduled(spark, d):
    """A scheduled run over all pages, done twice as after a stop."""
    base = shared_folder(spark, "scheduled")
    folders = schedule.Folders(f"{base}/store", f"{base}/scores", f"{base}/letters", f"{base}/csv")
    for _ in range(2):
        schedule.run_once(
            spark, folders, 0, inputs.lexicon(spark), inputs.feeds(spark, d), inputs.site_table(spark, d),
            inputs.sitemaps(spark, d), inputs.crawl(spark, d).select("page_id", "url", "html"),
            max_per_source=inputs.MAX_PER_SITE, min_len=inputs.MIN_LEN, now=inputs.NOW,
        )
    return folders


def scheduled_run(spark, d):
    folders = _scheduled(spark, d)
    return incremental.scored_store(spark, folders.store, folders.scores).select(
        "id", "title", "url", "created_at", F.col("vader_compound").isNotNull().alias("scored"))


def scheduled_letters(spark, d):
    return store.read_batches(spark, _scheduled(spark, d).letters, schemas.DEAD_LETTER)


def stream_score(spark, d):
    """Stored articles in two batches, scored after each; the scores table."""
    base = shared_folder(spark, "score")
    saved, scores, checkpoint = f"{base}/store", f"{base}/scores", f"{base}/checkpoint"
    lex = inputs.lexicon(spark)
    for i, rows in enumerate((inputs.store(spark, d), inputs.batch(spark, d))):
        store.append_batch(spark, rows, saved, i)
        incremental.score_store(spark, saved, scores, checkpoint, lex)
    return store.read_batches(spark, scores, schemas.SCORES)


QUERIES = {
    "feed_items": feed_items,
    "feed_health": feed_health,
    "sitemap_urls": sitemap_urls,
    "sitemap_health": sitemap_health,
    "sitemap_guess": sitemap_guess,
    "feed_probe_pick": feed_probe_pick,
    "feed_link_html": feed_link_html,
    "find_feeds": find_feeds,
    "discover_all": discover_all,
    "discover_counts": discover_counts,
    "dedupe_keep_first": dedupe_keep_first,
    "load_articles": load_articles,
    "extract_layer1": _layer("layer1"),
    "extract_layer2": _layer("layer2"),
    "extract_layer3": _layer("layer3"),
    "extract_articles": extract_articles,
    "extract_counts": extract_counts,
    "doc_keywords": doc_keywords,
    "doc_summary": doc_summary,
    "insert_new": insert_new,
    "insert_counts": insert_counts,
    "score_unscored": score_unscored,
    "backfill_sources": backfill_sources,
    "backfill_count": backfill_count,
    "repaired_store": repaired_store,
    "store_table": store_table,
    "ensure_columns": ensure_columns,
    "csv_roundtrip": csv_roundtrip,
    "dead_letters": dead_letters_of_run,
    "dead_letter_retention": dead_letter_retention,
    "article_urls": article_urls,
    "url_domain": url_domain,
    "clean_source": clean_source,
    "title_tokens": title_tokens,
    "snippet": snippet,
    "parse_dates": parse_dates,
    "join_authors": join_authors,
    "score_compound": score_compound,
    "score_polarity": score_polarity,
    "score_articles": score_articles,
    "score_articles_joined": score_articles_joined,
    "kpi_strip": kpi_strip,
    "agreement_rate": agreement_rate,
    "label_distribution": label_distribution,
    "relabel": relabel,
    "eligible_sources": eligible_sources,
    "filter_sources": filter_sources,
    "filter_selected": filter_selected,
    "filter_unselected": filter_unselected,
    "sentiment_by_source": sentiment_by_source,
    "top_positive": _top("positive"),
    "top_negative": _top("negative"),
    "top_headlines_both": top_headlines_both,
    "term_frequency": term_frequency,
    "word_text_by_source": word_text_by_source,
    "raw_scored": raw_scored,
    "scorer_scatter": scorer_scatter,
    "scorer_scatter_bins": scorer_scatter_bins,
    "score_badge": score_badge,
    "db_stats": db_stats,
    "store_size_text": store_size_text,
    "is_empty_store": is_empty_store,
    "top_sources": top_sources,
    "top_languages": top_languages,
    "source_bars": source_bars,
    "extractor_breakdown": extractor_breakdown,
    "preview": preview,
    "run_summary": run_summary,
    "stream_ingest": stream_ingest,
    "stream_dead_letters": stream_dead_letters,
    "stream_score": stream_score,
    "mixed_writers": mixed_writers,
    "scheduled_run": scheduled_run,
    "scheduled_letters": scheduled_letters,
}
