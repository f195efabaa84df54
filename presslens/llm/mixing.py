"""Mixing sources to target weights with weighted sampling keys.

Every document draws an exponential key divided by its quality weight. A source's
documents in key order are a weighted sample without replacement, at any length.
A source that must give more than it has is taken whole as often as that fits
(complete epochs); the rest of its target is a prefix of the key order.

The prefix sums are cut at fixed points of the key range: sums per (source, bucket)
are aggregated before any shuffle, and rows are ordered within a bucket only, so a
source with a third of all rows is spread over ``buckets`` tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presslens.llm.common import WORD, table
from presslens.session import written

LEAST_WEIGHT = 1e-6
HEX_DIGITS = 13


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: str) -> Column:
    """A number above 0 and below 1 that depends on the id and the seed alone."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":" + seed)).cast("binary"))
    whole = F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("long")
    return (whole.cast("double") + 0.5) / float(16 ** HEX_DIGITS)


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: int) -> DataFrame:
    """``key, source, source_size`` to each source's target.

    Sources by code point, null last, take the weights in turn. Targets share
    ``share`` of all sizes; none exceeds ``most`` times its source's size, and what
    is above goes to the others by weight until none is above. That end is reached
    directly: sources in order of most * size / weight fill up first, so the common
    level is the first at which its own source is not full; later ones are lower.
    """
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn(
        "turn", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    ).withColumn("weight", F.element_at(turn, (F.col("turn") + 1).cast("int")))
    limit = F.col("source_size") * most
    order = Window.orderBy(limit / F.col("weight"), F.col("key"))
    everything = Window.partitionBy()
    levels = (
        ranked
        .withColumn("filled", F.coalesce(F.sum(limit).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("level", (F.col("total") - F.col("filled")) / F.col("open"))
        .withColumn("level", F.max(F.when(F.col("level") <= limit / F.col("weight"), F.col("level"))).over(everything))
    )
    target = F.coalesce(F.least(F.col("level") * F.col("weight"), limit.cast("double")), limit.cast("double"))
    return levels.select("key", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    size: Column | None = None,
    quality: Column | None = None,
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    share: float = 1.0,
    most: int = 3,
    doc_id: str = "doc_id",
    source: str = "source",
    seed: str = "mix",
    buckets: int = 1024,
) -> DataFrame:
    """How often, and how far, the mix takes each row of ``docs``.

    ``size`` is a row's whole number of tokens (default: words of ``text``),
    ``quality`` its sampling weight (default 1; null counts as 1, anything below
    1e-6 as 1e-6). Returns ``row`` (the input row), ``size``, ``source_size``,
    ``target`` (its source's), ``epochs`` (times taken whole), ``part`` (tokens of
    one further, partial or whole, take) and ``taken`` = epochs * size + part.
    Taken tokens of a source add up to its target, rounded down.

    Null source: a source of its own, last in order. Null id: ordered like an empty
    one. Null or empty text: size 0, taken 0. Ties of the key are ordered by id, then
    size; rows equal in all these are interchangeable. Repeated rows are rows. An
    empty table gives no rows. Other columns, of any name, stay inside ``row``.
    """
    size = word_count(F.col("text")) if size is None else size
    weight = F.lit(1.0) if quality is None else F.coalesce(quality.cast("double"), F.lit(1.0))
    weight = F.greatest(weight, F.lit(LEAST_WEIGHT))
    draw = uniform(F.col(doc_id), seed)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")).alias("key"),
        F.col(source).alias("source"),
        F.col(doc_id).alias("id"),
        size.cast("long").alias("size"),
        (-F.ln(draw) / weight).alias("draw"),
        F.floor((1.0 - F.pow(draw, 1.0 / weight)) * buckets).cast("int").alias("bucket"),
    )
    sums = rows.groupBy("key", "bucket").agg(F.max("source").alias("source"), F.sum("size").alias("held"))
    sizes = sums.groupBy("key").agg(F.max("source").alias("source"), F.sum("held").alias("source_size"))
    targets = source_targets(sizes, weights, share, most)
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        sums.select("key", "bucket", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("ahead"))
        .join(targets, "key")
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("budget", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    )
    within = Window.partitionBy("key", "bucket").orderBy("draw", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.drop("source").join(cuts, ["key", "bucket"])
        .withColumn("before", F.col("ahead") + F.coalesce(F.sum("size").over(within), F.lit(0)))
        .withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("before"))))
        .select("row", "size", "source_size", "target", "epochs", "part",
                (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"))
    )


def copies(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The rows that the mix takes: whole copies, then the partial one, cut after its words."""
    whole = F.col("epochs") + F.when((F.col("part") == F.col("size")) & (F.col("size") > 0), 1).otherwise(0)
    partial = (F.col("part") > 0) & (F.col("part") < F.col("size"))
    takes = F.concat(
        F.array_repeat(F.lit(False), whole.cast("int")),
        F.when(partial, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")),
    )
    taken = mixed.select("row", "part", F.explode(takes).alias("cut"))
    words = F.regexp_extract_all(F.col(f"row.{text}"), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), 0)
    first = F.array_join(F.slice(words, F.lit(1), F.col("part").cast("int")), "")
    shorter = F.when(F.col("cut"), first).otherwise(F.col(f"row.{text}"))
    fields = mixed.schema["row"].dataType.names
    return taken.select(*[
        (shorter if f == text else F.length(shorter).cast("long") if f == "n_chars" else F.col(f"row.`{f}`")).alias(f)
        for f in fields
    ])


def quality_weights(labels: DataFrame) -> DataFrame:
    """Sampling weight of labelled documents: 2 for quality 1, 0.5 for quality 0."""
    best = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("labelled")).agg(F.max("quality").alias("quality"))
    return best.select("labelled", F.when(F.col("quality") >= 1, 2.0).when(F.col("quality") <= 0, 0.5).otherwise(1.0).alias("weight"))


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    """All documents mixed by 5, 2, 1, labelled quality as sampling weight."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    sized = written(docs, "mix-sizes")
    weights = quality_weights(table(spark, sf_dir, "labels"))
    joined = sized.join(weights, F.col("doc_id") == F.col("labelled"), "left")
    out = mix(joined, F.col("size"), F.col("weight"))
    return out.select("row.doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH best AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
docs AS (
  SELECT d.doc_id, d.source,
         CAST(coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         -ln((CAST(CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || ':mix'), 1, 13) AS BIGINT) AS DOUBLE) + 0.5)
             / 4503599627370496.0)
           / CASE WHEN b.quality >= 1 THEN 2.0::DOUBLE WHEN b.quality <= 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS draw
  FROM documents d LEFT JOIN best b ON b.doc_id = d.doc_id),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
ranked AS (
  SELECT source, source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM sizes),
levels AS (
  SELECT *, (sum(source_size) OVER ()
             - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY 3 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
targets AS (
  SELECT source, source_size,
         least(max(CASE WHEN level <= 3 * source_size / weight THEN level END) OVER () * weight, CAST(3 * source_size AS DOUBLE)) AS target
  FROM levels),
plans AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM targets),
ordered AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.epochs,
         CAST(floor(p.target - p.epochs * p.source_size) AS BIGINT)
           - coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id, d.size
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
  FROM docs d JOIN plans p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, room)) AS BIGINT) AS taken
FROM ordered
"""
