import pytest

from checks import inputs
from presslens import schemas
from presslens.operators.extract import extract_articles
from presslens.operators.store import append_batch, read_batches
from presslens.plans.run import NothingToDo, pages_to_try, run_batch, score_new, store_run
from presslens.plans.schedule import Folders, run_once
from presslens.sources.articles import load_articles
from presslens.streaming import incremental

SF = "/root/testdata/sf0.001"


def test_two_drops_equal_one_batch(spark, tmp_path):
    landed, store, scores = (str(tmp_path / n) for n in ("landed", "store", "scores"))
    pages = inputs.crawl(spark, SF).select("page_id", "url", "html")
    lex = inputs.lexicon(spark)

    def step():
        incremental.ingest_pages(spark, landed, store, str(tmp_path / "c1"), min_len=600)
        incremental.score_store(spark, store, scores, str(tmp_path / "c2"), lex)
        return (read_batches(spark, store, schemas.STORED).count(),
                read_batches(spark, scores, schemas.SCORES).count())

    pages.where("page_id < 30").write.parquet(landed)
    first = step()
    assert first[0] == first[1] > 0
    pages.where("page_id >= 20").write.mode("append").parquet(landed)  # ten pages again
    second = step()
    assert second[0] == second[1] > first[0]
    assert step() == second  # nothing new landed: nothing is stored or scored
    saved = incremental.scored_store(spark, store, scores)
    assert saved.where("vader_compound IS NULL").isEmpty()
    assert saved.select("url").distinct().count() == saved.count()
    loaded = load_articles(saved)
    assert loaded.columns == schemas.LOAD_COLUMNS and loaded.count() == second[0]


def test_nothing_stored_yet_is_nothing_to_score(spark, tmp_path):
    landed, store, scores, letters = (str(tmp_path / n) for n in ("landed", "store", "scores", "letters"))
    spark.createDataFrame([(1, "https://a.com/x", "<html></html>")], schemas.PAGE).write.parquet(landed)
    incremental.ingest_pages(spark, landed, store, str(tmp_path / "c1"), letters=letters)
    incremental.score_store(spark, store, scores, str(tmp_path / "c2"), inputs.lexicon(spark))
    assert read_batches(spark, store, schemas.STORED).isEmpty()
    assert [r.url for r in read_batches(spark, letters, schemas.DEAD_LETTER).collect()] == ["https://a.com/x"]


def test_a_new_checkpoint_overwrites_nothing(spark, tmp_path):
    landed, store, scores = (str(tmp_path / n) for n in ("landed", "store", "scores"))
    pages = inputs.crawl(spark, SF).select("page_id", "url", "html")
    lex = inputs.lexicon(spark)
    saved = inputs.store(spark, SF).where("id < 40").selectExpr("id + 1000000 as id", "* except (id)")
    append_batch(spark, saved, store, 0)
    for n, part in enumerate(("page_id < 30", "page_id >= 20")):
        pages.where(part).write.mode("append").parquet(landed)
        incremental.ingest_pages(spark, landed, store, str(tmp_path / f"i{n}"), min_len=600)
        incremental.score_store(spark, store, scores, str(tmp_path / f"s{n}"), lex)
    rows = read_batches(spark, store, schemas.STORED)
    wanted = extract_articles(pages, 600)
    assert rows.count() == saved.select("url").distinct().count() + wanted.select("url").distinct().count()
    assert read_batches(spark, scores, schemas.SCORES).count() == rows.count()


def test_a_run_in_which_every_page_fails_leaves_its_letters(spark, tmp_path):
    folders = Folders(*(str(tmp_path / n) for n in ("store", "scores", "letters")))
    args = (inputs.feeds(spark, SF), inputs.site_table(spark, SF), inputs.sitemaps(spark, SF))
    pages = inputs.crawl(spark, SF).select("page_id", "url", "html")
    done = run_once(spark, folders, 0, inputs.lexicon(spark), *args, pages.limit(0), now=inputs.NOW)
    assert done.first and done.inserted == done.scored == 0 and done.summary is None
    assert read_batches(spark, folders.letters, schemas.DEAD_LETTER).count() > 0
    again = run_once(spark, folders, 1, inputs.lexicon(spark), *args, pages, min_len=600, now=inputs.NOW)
    assert again.first and again.inserted == again.scored > 0


def test_batch_run_end_to_end(spark, tmp_path):
    args = (inputs.feeds(spark, SF), inputs.site_table(spark, SF), inputs.sitemaps(spark, SF),
            inputs.crawl(spark, SF).select("page_id", "url", "html"))
    none = spark.createDataFrame([], schemas.STORED)
    run = run_batch(*args, none, min_len=600, now=inputs.NOW)
    row = run.summary.first()
    assert row["urls_discovered"] == row["scraped"] + row["failed"]
    assert run.failures.count() == row["failed"]
    path = str(tmp_path / "store")
    assert store_run(spark, run, path, 0, inputs.NOW) == (row["new_in_store"], row["duplicates"])
    saved = read_batches(spark, path, schemas.STORED)
    lex, scores = inputs.lexicon(spark), str(tmp_path / "scores")
    assert score_new(spark, saved, scores, 0, lex) == row["new_in_store"]
    assert score_new(spark, saved, scores, 0, lex) == row["new_in_store"]  # the same batch again
    assert score_new(spark, saved, scores, 1, lex) == 0
    again = run_batch(*args, read_batches(spark, path, schemas.STORED), min_len=600, now=inputs.NOW)
    assert again.summary.first()["new_in_store"] == 0


def test_run_stops_without_urls_or_articles(spark):
    feeds, sites = inputs.feeds(spark, SF), inputs.site_table(spark, SF)
    docs = inputs.sitemaps(spark, SF)
    pages = inputs.crawl(spark, SF).select("page_id", "url", "html")
    none = spark.createDataFrame([], schemas.STORED)
    with pytest.raises(NothingToDo, match="URLs"):
        run_batch(feeds.limit(0), sites.limit(0), docs, pages, none)
    with pytest.raises(NothingToDo, match="articles"):
        run_batch(feeds, sites, docs, pages.limit(0), none)


def test_newest_page_of_a_hot_url(spark):
    pages = spark.createDataFrame(
        [(i, "hot" if i % 3 == 0 else f"u{i}", f"h{i}") for i in range(90)], schemas.PAGE)
    urls = spark.createDataFrame([("hot",), ("u1",), ("never landed",)], "url string")
    got = sorted(tuple(r) for r in pages_to_try(urls, pages).collect())
    assert got == [(1, "u1", "h1"), (87, "hot", "h87")]
