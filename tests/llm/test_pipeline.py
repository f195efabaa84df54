"""The pipeline's stages against plain Python, one by one and as a whole."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from presslens.llm import mixing, quality
from tests.llm.test_near import grams

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage wrote, by name, from the documents on."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_names_and_columns(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "ngram_jaccard_join", "secret_scans", "mixing_sources", "best_fit_packing"]
    for name in names[:-1]:
        assert stages[name].dtypes == stages["documents"].dtypes


def test_quality_keeps_what_scores_half(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = quality.classify(stages["documents"], labels).collect()
    assert set(rows_of(stages["quality_classifier"])) == {r.doc_id for r in scored if r.predicted == 1}
    marked = {r.doc_id: r.quality for r in labels.collect()}
    kept = set(rows_of(stages["quality_classifier"]))
    wrong = [i for i, q in marked.items() if (i in kept) != (q == 1)]
    assert len(wrong) <= 0.05 * len(marked)


def test_one_of_each_group_stays(stages):
    before, after = rows_of(stages["quality_classifier"]), rows_of(stages["ngram_jaccard_join"])
    sets = {i: grams(r.text, 5) for i, r in before.items()}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert set(after) == {i for i in sets if root(i) == i} and len(after) < len(before)
    assert all(after[i] == before[i] for i in after)


def test_secrets_go_and_nothing_else(stages):
    before, after = rows_of(stages["ngram_jaccard_join"]), rows_of(stages["secret_scans"])
    for i, r in before.items():
        text = re.sub(r'(token = ")[0-9a-f]{40}(")', r"\1[SECRET]\2", r.text)
        assert after[i].text == text and after[i].n_chars == len(text)
    assert set(after) == set(before)


def test_mix_takes_the_targets(stages):
    sizes = defaultdict(int)
    for r in stages["secret_scans"].collect():
        sizes[r.source] += len(r.text.split())
    want = {r["source"]: r.target for r in mixing.mix(stages["secret_scans"]).selectExpr("row.source as source", "target").distinct().collect()}
    taken, copies = defaultdict(int), Counter()
    for r in stages["mixing_sources"].collect():
        taken[r.source] += len(r.text.split())
        copies[r.doc_id] += 1
    for source, target in want.items():
        assert taken[source] == pytest.approx(target, abs=1.001)
        assert target <= 3 * sizes[source] + 1e-6
    assert max(copies.values()) <= 3


def test_all_tokens_are_packed(stages):
    held, tokens = defaultdict(list), Counter()
    for r in stages["best_fit_packing"].collect():
        held[r.sequence_id].append((r.offset, r.length))
        tokens[r.doc_id] += r.length
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert set(tokens) == {r.doc_id for r in stages["mixing_sources"].collect()}
    assert len(held) <= 1.1 * -(-sum(tokens.values()) // 4096) + 1


def test_messy_and_empty_documents(spark, messy, nothing, tmp_path):
    for n, docs in enumerate((messy, nothing)):
        kept = docs
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{n}-{name}")
            stage(spark, kept, SF).write.parquet(path)
            kept = spark.read.parquet(path)
            if name != "best_fit_packing":
                assert kept.columns == docs.columns
            if name == "ngram_jaccard_join" and n == 0:
                ids = Counter(r.doc_id for r in kept.select("doc_id").collect())
                assert ids[1] <= 1 and ids[2] == ids[10] == 0
        assert (kept.count() == 0) == (n == 1)


def test_run_is_the_stages(spark, stages):
    run = corpus_pipeline.run(spark, SF)
    assert run.columns == stages["best_fit_packing"].columns
    key = F.col("ids_crc32")
    assert run.select("doc_id", "piece", key).exceptAll(stages["best_fit_packing"].select("doc_id", "piece", key)).isEmpty()


def test_helper_names_of_the_stages_are_kept_as_columns(spark, tmp_path):
    clashing = ("weight", "labelled", "_turn", "cut", "told", "scored", "starts", "findings", "redacted", "__carried_0")
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    docs = docs.select("*", *[F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")).alias(c) for c in clashing])
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = str(tmp_path / name)
        stage(spark, kept, SF).write.parquet(path)
        out = spark.read.parquet(path)
        assert out.columns == docs.columns
        bad = out.where(~F.expr(" AND ".join(
            f"(doc_id IS NULL OR `{c}` = concat('{c}-', CAST(doc_id AS STRING)))" for c in clashing)))
        assert bad.isEmpty(), name
        kept = out
    assert corpus_pipeline.STAGES[-1][1](spark, kept, SF).count() > 0
