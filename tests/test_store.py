import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from presslens import schemas
from presslens.operators import csv_export, dead_letters, dedupe, report, store
from presslens.plans.run import NothingToDo, require_rows
from presslens.sources.articles import is_empty_store

SAMPLE = {
    "title": "A title", "authors": "Somebody", "date": "2025-01-01", "summary": "short",
    "text": 'Body with "quotes",\ncommas and lines ' * 10, "tags": "a, b",
    "url": "https://example.com/a", "source": "example.com", "language": "en",
    "extracted_by": "layer1", "scraped_at": "2025-01-01 08:00:00",
}


def articles(spark, *changes):
    rows = [{**SAMPLE, **c} for c in changes]
    fields = [schemas.STORED["id"], *schemas.ARTICLE.fields]
    return spark.createDataFrame(
        [(i, *[r[c] for c in schemas.ARTICLE_COLUMNS]) for i, r in enumerate(rows)],
        StructType(fields),
    )


def urls(df, *more):
    return sorted((tuple(r) for r in df.select("id", *more, "url").collect()), key=str)


def counts(spark, batch, saved):
    row = store.insert_counts(batch, saved).first()
    return row["inserted"], row["duplicates"]


@pytest.mark.parametrize("given, expected", [
    ("aba", "ab"), ("cab", "cab"), ("", ""), ("aaaaa", "a"),
])
def test_keep_first_keeps_order(spark, given, expected):
    df = spark.createDataFrame(list(enumerate(given)), "pos int, url string")
    got = dedupe.keep_first(df, "url", "pos").orderBy("pos").collect()
    assert "".join(r["url"] for r in got) == expected


def test_insert_counts(spark):
    none = articles(spark)
    one = articles(spark, {})
    five = articles(spark, *[{"url": f"https://example.com/{i}"} for i in range(5)])
    assert counts(spark, none, none) == (0, 0)
    assert counts(spark, one, none) == (1, 0)
    assert counts(spark, one, one) == (0, 1)
    assert counts(spark, five, none) == (5, 0)
    assert counts(spark, five, one) == (5, 0)


def test_null_urls_are_all_inserted_and_first_wins(spark):
    batch = articles(
        spark, {"url": None}, {"url": None}, {"title": "first"}, {"title": "second"}, {"url": "k"})
    saved = articles(spark, {"url": "k"}, {"url": None})
    got = store.insert_new(batch, saved)
    assert urls(got, "title") == sorted(
        [(0, "A title", None), (1, "A title", None), (2, "first", SAMPLE["url"])], key=str)


def test_a_hot_url_is_stored_once(spark):
    batch = articles(spark, *[{} for _ in range(400)], *[{"url": f"u{i}"} for i in range(20)])
    assert counts(spark, batch, articles(spark)) == (21, 399)


def test_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "store")
    assert is_empty_store(spark, path)
    batch = articles(spark, {}, {"url": "b"}, {"url": "b"})
    assert store.append_batch(spark, batch, path, 0) == (2, 1)
    assert store.append_batch(spark, batch, path, 0) == (2, 1)  # the same batch again
    assert store.append_batch(spark, batch, path, 1) == (0, 3)  # the same rows as a new batch
    assert store.read_batches(spark, path, schemas.STORED).count() == 2
    more = articles(spark, {"url": "c"})
    assert store.append_batch(spark, more, path, 0, writer="other") == (1, 0)  # another writer's batch 0
    assert urls(store.read_batches(spark, path, schemas.STORED)) == sorted(
        [(0, "c"), (0, SAMPLE["url"]), (1, "b")], key=str)
    with pytest.raises(ValueError, match="writer"):
        store.append_batch(spark, more, path, 0, writer="a/b")
    assert not is_empty_store(spark, path)


def test_init_store_twice(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS presslens_t LOCATION '{tmp_path}/db'")
    store.init_store(spark, "presslens_t.articles")
    store.init_store(spark, "presslens_t.articles")
    assert spark.table("presslens_t.articles").count() == 0
    assert spark.table("presslens_t.articles").columns == schemas.STORED.fieldNames()
    spark.sql("DROP TABLE presslens_t.articles")


def test_ensure_columns_and_merge(spark):
    saved = store.ensure_columns(articles(spark, {}, {"url": "b"}))
    assert store.ensure_columns(saved).columns == saved.columns
    assert store.unscored(saved).count() == 2
    scores = spark.createDataFrame(
        [(1, 0.5, "positive", 0.1, 0.9, 0.0, 0.2, "positive", 0.3)], schemas.SCORES)
    merged = store.merge_scores(saved, scores)
    assert [r["vader_compound"] for r in merged.orderBy("id").collect()] == [None, 0.5]
    again = store.merge_scores(merged, scores.withColumn("vader_compound", scores.vader_compound * 0))
    assert [r["vader_compound"] for r in again.orderBy("id").collect()] == [None, 0.5]
    assert store.without_scores(saved, scores).count() == 1


def test_backfill(spark):
    df = articles(spark, {"source": None}, {"source": ""}, {"source": "N/A", "url": None}, {})
    got = store.backfill_sources(df).orderBy("id").collect()
    assert [r["source"] for r in got] == ["example.com", "example.com", "N/A", "example.com"]
    assert store.backfill_count(df).first()["updated"] == 3


def test_stats(spark):
    df = articles(
        spark, *[{"source": s, "url": s} for s in ("b", "a", "b", "", "N/A", None)],
        {"scraped_at": "2025-01-02 01:00:00", "language": "N/A"})
    assert tuple(report.db_stats(df, "2025-01-01").first()) == (7, 6)
    assert [tuple(r) for r in report.top_sources(df, 3).collect()] == [("b", 2), ("", 1), ("a", 1)]
    assert [tuple(r) for r in report.top_languages(df).collect()] == [("en", 6)]
    assert report.source_bars(df).first()["bar"] == "██"
    empty = articles(spark)
    assert tuple(report.db_stats(empty, "2025-01-01").first()) == (0, 0)
    assert report.top_sources(empty).collect() == []


def test_csv_roundtrip(spark, tmp_path):
    df = articles(spark, {}, {"url": "b", "source": None, "title": ' "x", y '}, {"url": "c", "text": "a\r\nb\\"})
    path = csv_export.export_csv(df, str(tmp_path), "20250101_000000")
    got = {r["url"]: r for r in csv_export.read_csv(spark, path).collect()}
    assert got[SAMPLE["url"]]["text"] == SAMPLE["text"]
    assert (got["b"]["source"], got["b"]["title"]) == ("", ' "x", y ')
    assert got["c"]["text"] == "a\r\nb\\"
    assert csv_export.export_csv(articles(spark), str(tmp_path), "x") == ""


def replay(old, new, limit):
    lines, rotated = old, False
    for _ in range(new):
        if lines >= limit:
            lines, rotated = lines - limit // 2 + 1, True
        lines += 1
    return lines, rotated


def test_retained_lines_by_brute_force():
    for limit in range(1, 20):
        for old in range(60):
            for new in range(60):
                assert dead_letters.retained_lines(old, new, limit) == replay(old, new, limit)


def letters(spark, start, stop):
    return spark.createDataFrame(
        [(f"2025-01-{i + 1:02}", "failed", f"u{i}") for i in range(start, stop)], schemas.DEAD_LETTER)


def test_dead_letter_rotation(spark):
    log = dead_letters.append_dead_letters(letters(spark, 0, 9), letters(spark, 9, 10), "now", 10)
    assert log.count() == 10 and not log.where("url is null").count()
    for _ in range(2):  # the second time with the first marker among the lines
        log = dead_letters.append_dead_letters(letters(spark, 0, 10), letters(spark, 10, 11), "now", 10)
        rows = log.orderBy("failed_at").collect()
        assert [r["url"] for r in rows] == ["u5", "u6", "u7", "u8", "u9", "u10", None]
        assert rows[-1]["reason"] == dead_letters.ROTATED
    grown = dead_letters.append_dead_letters(log, letters(spark, 11, 16), "later", 10)
    rows = grown.orderBy("failed_at").collect()
    assert [r["url"] for r in rows][:-1] == ["u9", "u10", "u11", "u12", "u13", "u14", "u15"]
    assert [r["failed_at"] for r in rows if not r["url"]] == ["later"]


def replayed(log, new, limit):
    """The log's lines after each new one is appended, as (reason, url)."""
    for line in new:
        if len(log) >= limit:
            log = [(dead_letters.ROTATED, None), *log[limit // 2:]]
        log = [*log, line]
    return log


@pytest.mark.parametrize("limit", [1, 2, 3, 4, 5, 6, 9])
def test_any_limit_keeps_what_a_replay_keeps(spark, limit):
    old, new = letters(spark, 0, 4).withColumn("reason", F.lit(None).cast("string")), letters(spark, 4, 15)
    got = dead_letters.append_dead_letters(old, new, "now", limit).select("reason", "url").collect()
    lines = [(None, f"u{i}") for i in range(4)], [("failed", f"u{i}") for i in range(4, 15)]
    assert sorted(map(tuple, got), key=str) == sorted(replayed(*lines, limit), key=str)


def test_stage_guard(spark):
    with pytest.raises(NothingToDo, match="no articles"):
        require_rows(articles(spark), "articles")
    assert require_rows(articles(spark, {}), "articles").count() == 1


def test_preview_and_breakdown(spark):
    df = articles(spark, *[{"url": str(i), "summary": "s" * 120, "tags": "t" * 90} for i in range(7)])
    rows = report.preview(df).collect()
    assert [r["id"] for r in rows] == [0, 1, 2, 3, 4]
    assert rows[0]["summary"] == "s" * 100 + "..." and rows[0]["tags"] == "t" * 80
    assert tuple(report.extractor_breakdown(df).first()) == ("layer1", 7)


def test_a_batch_reads_only_the_url_buckets_it_touches(spark, tmp_path):
    path = str(tmp_path / "store")
    many = articles(spark, *[{"url": f"https://site{i}.example/a"} for i in range(300)], {"url": None})
    assert store.append_batch(spark, many, path, 0) == (301, 0)
    written = {int(p.name.split("=")[1]) for p in (tmp_path / "store/writer=batch/ingest_batch=0").glob("url_bucket=*")
               if not p.name.endswith("__")}
    assert len(written) > 50  # URLs spread over many buckets
    batch = articles(spark, {"url": "https://site7.example/a"}, {"url": "https://new.example/x"}, {"url": None})
    touched = store.touched_buckets(batch)
    assert 1 <= len(touched) <= 2
    known = store.read_batches(spark, path, schemas.STORED, url_buckets=touched)
    plan = known.select("url")._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    assert "url_bucket" in filters and " IN (" in filters
    assert "ReadSchema: struct<url:string>" in plan
    assert known.count() < 10
    assert {r.url for r in known.collect()} >= {"https://site7.example/a"}
    # the same rows as a lookup in the whole store
    whole = store.read_batches(spark, path, schemas.STORED)
    assert urls(store.insert_new(batch, known)) == urls(store.insert_new(batch, whole))
    assert store.append_batch(spark, batch, path, 1) == (2, 1)
    assert store.read_batches(spark, path, schemas.STORED).count() == 303


def test_repair_writes_sources_into_touched_partitions_only(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [{"url": f"https://www.site{i}.example/a", "source": None if i % 50 == 0 else "kept"} for i in range(300)]
    rows += [{"url": None, "source": ""}, {"url": "https://[bad/x", "source": None}]
    batch = articles(spark, *rows)
    assert store.append_batch(spark, batch, path, 0) == (302, 0)
    folder = tmp_path / "store/writer=batch/ingest_batch=0"
    before = {p.name: sorted(f.name for f in p.iterdir()) for p in folder.iterdir() if p.is_dir()}
    expected = sorted((tuple(r) for r in store.backfill_sources(batch).select("id", "source").collect()), key=str)
    assert store.repair_sources(spark, path) == 7  # six domains and one N/A for a null URL's empty source
    after = {p.name: sorted(f.name for f in p.iterdir()) for p in folder.iterdir() if p.is_dir()}
    changed = {k for k in before if before[k] != after.get(k)}
    assert 1 <= len(changed) <= 8 and set(after) == set(before)
    stored = store.read_batches(spark, path, schemas.STORED)
    assert sorted((tuple(r) for r in stored.select("id", "source").collect()), key=str) == expected
    assert store.repair_sources(spark, path) == 0
    assert stored.count() == 302


def test_catalog_table_over_the_store(spark, tmp_path):
    path = str(tmp_path / "store")
    store.init_store(spark, "presslens_over_store", path)
    store.init_store(spark, "presslens_over_store", path)
    batch = articles(spark, {"url": "a"}, {"url": "b"}, {"url": "b"}, {"url": None})
    assert store.append_batch(spark, batch, path, 0, table="presslens_over_store") == (3, 1)
    assert store.append_batch(spark, batch, path, 1, table="presslens_over_store") == (1, 3)
    by_sql = spark.sql("SELECT id, url FROM presslens_over_store")
    assert urls(by_sql) == urls(store.read_batches(spark, path, schemas.STORED))
    assert by_sql.count() == 4
    pruned = spark.sql("SELECT url FROM presslens_over_store WHERE url_bucket = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in pruned and "url_bucket" in pruned
    spark.sql("DROP TABLE presslens_over_store")
