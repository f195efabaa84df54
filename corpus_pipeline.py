"""A training corpus from documents: filter, dedupe, redact, mix, pack.

Every stage takes ``documents`` as the one before it left them and returns the same
columns; the last returns the places of their tokens in training sequences. Each
stage's operator states what it does with nulls, empty texts and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from presslens.llm import mixing, near, packing, quality, secrets, tokens
from presslens.llm.common import table
from presslens.session import written

#: Most labels that are sent to every executor; more are joined by shuffling.
SENT_LABELS = 1_000_000
#: Columns of documents that stages read; any other is carried under a name of its own.
READ = ("doc_id", "text", "lang", "source", "n_chars")


def carried(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with every other column renamed to a name no stage uses, and the names.

    Helper columns of the stages (``weight``, ``labelled``, ``_turn``, ``cut`` and the
    like) then never meet a column of the caller's; ``back`` restores the names.
    """
    names = {c: c if c in READ else f"__carried_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def back(df: DataFrame, names: dict[str, str], new: dict | None = None) -> DataFrame:
    """The columns of the documents, by their own names; ``new`` replaces some."""
    new = new or {}
    return df.select(*[new.get(c, F.col(f"`{n}`")).alias(c) for c, n in names.items()])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score 0.5 or more)."""
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 0.8) the document of the smallest id.

    Documents without an id are in no group and stay.
    """
    docs, names = carried(docs)
    groups = near.near_groups(docs)
    first = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    named = docs.where(F.col("doc_id").isNotNull()).join(first, "doc_id", "left_semi")
    again = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id")
    once = named.withColumn("_turn", F.row_number().over(again)).where(F.col("_turn") == 1)
    return back(once.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull())), names)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked."""
    docs, names = carried(docs)
    found = secrets.scan(docs, secrets.forest_of(docs))
    changed = ~F.col("text").eqNullSafe(F.col("redacted"))
    new = {"text": F.col("redacted"), "n_chars": F.when(changed, F.length("redacted").cast("long")).otherwise(F.col("n_chars"))}
    return back(found, names, new)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the last of a source cut to its words."""
    docs, names = carried(docs)
    weights = mixing.quality_weights(table(spark, sf_dir, "labels"))
    if weights.count() <= SENT_LABELS:
        weights = F.broadcast(weights)
    weighted = docs.join(weights, F.col("doc_id") == F.col("labelled"), "left").drop("labelled")
    return back(mixing.copies(mixing.mix(weighted, quality=F.col("weight"))), names)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all tokens in sequences of 4096."""
    return packing.pack(docs, tokens.vocabulary())


STAGES = [
    ("quality_classifier", keep_quality),
    ("ngram_jaccard_join", keep_one_of_near),
    ("secret_scans", redact_secrets),
    ("mixing_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Stages of this pipeline go beyond SQL; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each read from what the one before it wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
