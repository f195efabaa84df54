"""Document fingerprints from spots: common words and the content words after them.

A spot is a run of anchor words with the two content words that follow it; a
text's fingerprint is the set of the hashes of its spots. Anchors are dense in prose
and sparse in lists, menus, code and other languages, so some other words, chosen by the
hash of their spot, count as anchors too. All work on texts is column expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presslens.functions.once import with_once
from presslens.llm.common import table

#: Anchors: very common short words of English, French, German and Spanish.
ANCHORS = (
    "the", "of", "and", "to", "in", "is", "for", "that", "was", "with",
    "de", "la", "le", "et", "les", "des", "un", "une", "que", "du",
    "der", "die", "das", "und", "den", "von", "zu", "mit",
    "el", "los", "las", "en", "por", "del",
)
MARK = "\x01"
#: So many spots, those of the smallest hashes, every text has besides those at anchors.
LEAST = 8
#: Of the other words, those whose spot's hash is a multiple of this have a spot too.
EVERY = 4
PART = r"\p{L}\p{M}\p{N}"


def _placed(text: Column, anchors: Sequence[str], chosen: Callable[[Column], Column]) -> Column:
    """``chosen`` spots, from an array of every word's ``hash`` and whether it is ``anchored``, sorted and distinct."""
    low = F.lower(F.coalesce(text, F.lit("")))
    tied = F.regexp_replace(low, rf"(?<![{PART}])({'|'.join(anchors)})[^{PART}]+(?=[{PART}])", f"$1{MARK}")
    items = F.filter(F.split(tied, rf"[^{PART}{MARK}]+"), lambda x: x != "")

    def every(words: Column) -> Column:
        return F.transform(words, lambda x, i: F.struct(
            F.hash(x, F.substring_index(F.coalesce(F.get(words, i + 1), F.lit("")), MARK, -1)).alias("hash"),
            F.contains(x, F.lit(MARK)).alias("anchored")))

    # a lambda's argument is computed once, an expression each time it is named
    placed = F.transform(F.array(items), every)
    return F.transform(placed, lambda all_: F.array_sort(F.array_distinct(chosen(all_))))[0]


def _anchored(found: Column) -> Column:
    return F.transform(F.filter(found, lambda s: s.anchored), lambda s: s.hash)


def spots(text: Column, anchors: Sequence[str] = ANCHORS) -> Column:
    """Sorted distinct hashes (32 bits) of the spots at anchors; null is empty.

    Every anchor is tied to what follows it, so the text becomes content words of
    which some carry the anchors before them.
    """
    return _placed(text, anchors, _anchored)


def text_spots(text: Column, anchors: Sequence[str] = ANCHORS, least: int = LEAST, every: int = EVERY) -> Column:
    """The spots that stand for a whole text, in any language, prose or not.

    They are those at anchors, about one in ``every`` of the other words', chosen by
    hash, and the ``least`` smallest hashes of all words' spots. One rule at every
    length: a word more or less changes the few spots it is part of, and the number
    follows the length where anchors are rare. A text of at most ``least`` words has
    a spot at every word.
    """
    smallest = lambda found: F.slice(F.array_sort(F.array_distinct(F.transform(found, lambda s: s.hash))), 1, least)
    kept = lambda found: F.transform(F.filter(found, lambda s: s.anchored | (F.pmod(s.hash, F.lit(every)) == 0)), lambda s: s.hash)
    return _placed(text, anchors, lambda found: F.concat(kept(found), smallest(found)))


def fingerprint(found: Column) -> Column:
    """The set as text: eight hexadecimal digits a spot, in order."""
    return F.array_join(
        F.transform(found, lambda h: F.lpad(F.lower(F.hex(h.cast("bigint") + F.lit(2147483648))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of spots; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, 1.0).otherwise(both / union)


def similar(found: DataFrame, percent: int = 80) -> DataFrame:
    """Pairs of ``doc_id, spots`` rows whose likeness is at least ``percent`` / 100.

    Equal sets are one row; each row stands for its smallest id. A set that is alike
    shares one of its first spots in hash order and has at least ``percent`` of the
    other's length, so candidates are joined by spot and length partition, and only
    they are compared. Returns ``class_id, other_id, likeness`` between classes; a
    row's class is the smallest id of its set. Empty sets and null ids are left out.
    """
    sets = found.where(F.col("doc_id").isNotNull() & (F.size("spots") > 0)).groupBy("spots").agg(F.min("doc_id").alias("doc_id"))
    n = F.size("spots")
    first = sets.select("doc_id", "spots", n.alias("n"), (n - F.ceil(n * percent / 100.0) + 1).cast("int").alias("first"))
    # lengths of a partition are within a factor; a partner's partition is the same or a neighbour
    part = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")
    keys = first.select("doc_id", "n", part.alias("part"), F.explode(F.slice("spots", F.lit(1), F.col("first"))).alias("spot"))
    home = keys.select("spot", "part", F.col("doc_id").alias("class_id"), F.col("n").alias("n_a"))
    near = keys.select("spot", F.explode(F.array("part", F.col("part") - 1, F.col("part") + 1)).alias("part"),
                       F.col("doc_id").alias("other_id"), F.col("n").alias("n_b"))
    pairs = home.join(near, ["spot", "part"]).where(
        (F.col("class_id") < F.col("other_id"))
        & (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    ).select("class_id", "other_id").distinct()
    a = sets.select(F.col("doc_id").alias("class_id"), F.col("spots").alias("a"))
    b = sets.select(F.col("doc_id").alias("other_id"), F.col("spots").alias("b"))
    compared = with_once(pairs.join(a, "class_id").join(b, "other_id"), "both", F.size(F.array_intersect("a", "b")))
    alike = compared.where(F.col("both") * 100 >= (F.size("a") + F.size("b") - F.col("both")) * percent)
    return alike.select("class_id", "other_id", likeness(F.col("a"), F.col("b")).alias("likeness"))


def _searched(bounds: list[int], value: Column) -> Column:
    """How many of the sorted ``bounds`` are not above ``value``, in two short steps."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i:i + step] for i in range(0, len(bounds), step)]
    literal = lambda xs: F.array(*[F.lit(x).cast("bigint") for x in xs])
    whole = F.size(F.filter(literal([g[0] for g in groups]), lambda b: b <= value))
    inside = F.size(F.filter(F.get(F.array(*map(literal, groups)), whole - 1), lambda b: b <= value))
    return F.when(whole > 0, (whole - 1) * step + inside).otherwise(0)


def with_next(
    docs: DataFrame, doc_id: str, tie: str, values: Sequence[str], derive: Callable[[DataFrame], DataFrame], buckets: int | None = None,
) -> DataFrame:
    """``derive(docs)`` with ``next_<v>`` of the next row by id, for the last row of the first.

    Rows are dealt to ranges of ids; each range also gets the first row of the next
    one, so every row finds its successor in its own task and wide columns move once.
    ``derive`` adds columns to rows where they have been dealt to.
    """
    spark = docs.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col(doc_id).alias("id"))
    cuts = ids.agg(F.percentile_approx("id", [i / buckets for i in range(1, buckets)], 100 * buckets).alias("q")).first()[0]
    bounds = sorted(set(cuts or []))  # at most ``buckets`` numbers
    bucket = F.when(F.col(doc_id).isNull(), 0).otherwise(_searched(bounds, F.col(doc_id))).cast("int")
    firsts = ids.withColumnRenamed("id", doc_id).groupBy(bucket.alias("bucket")).agg(
        F.min(doc_id).alias("id"), F.max(F.col(doc_id).isNull()).alias("empty")).orderBy("bucket").collect()  # a row a bucket
    if not firsts:
        starts, previous = F.array().cast("array<bigint>"), F.array().cast("array<int>")
    else:
        first = {r.bucket: None if r.empty else r.id for r in firsts}
        before = {b.bucket: firsts[i - 1].bucket for i, b in enumerate(firsts)}
        top = firsts[-1].bucket + 1
        starts = F.array(*[F.lit(first.get(b)).cast("bigint") for b in range(top)])
        previous = F.array(*[F.lit(before.get(b, -1)).cast("int") for b in range(top)])
    lowest = firsts[0].bucket if firsts else 0
    own = F.struct(F.col("_bucket").alias("bucket"), F.lit(0).alias("copy"))
    other = F.struct(F.get(previous, F.col("_bucket")).alias("bucket"), F.when(F.col("_bucket") == lowest, 2).otherwise(1).alias("copy"))
    targets = F.when(F.col(doc_id).eqNullSafe(F.get(starts, F.col("_bucket"))), F.array(own, other)).otherwise(F.array(own))
    dealt = docs.withColumn("_bucket", bucket).withColumn("_to", F.explode(targets)).select(
        *[F.col(c) for c in docs.columns], F.col("_to.bucket").alias("_range"), F.col("_to.copy").alias("_copy"))
    here = derive(dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_range"))
    order = Window.partitionBy("_range").orderBy((F.col("_copy") == 2).cast("int"), F.col(doc_id).asc_nulls_first(), "_copy", tie)
    led = here.select("*", *[F.lead(v).over(order).alias(f"next_{v}") for v in values])
    return led.where(F.col("_copy") == 0).drop("_range", "_copy")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text.

    ``docs`` has ``doc_id, text``. The edited text replaces the last half of the code
    points (rounded down) by the first as many of the next document's, in order of
    id, ties by a hash of the text; after the last comes the first. Null ids come
    first. Null text: empty, with an empty fingerprint. Repeated rows follow each
    other. An empty table gives no rows. Other columns are not read.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    paired = with_next(
        base.withColumn("tie", F.xxhash64("text")), "doc_id", "tie", ["text", "spots"],
        lambda rows: with_once(rows, "spots", text_spots(F.col("text"))))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    both = with_once(paired.withColumn("n_chars", n.cast("long")), "edited", edited).drop("text", "next_text", "tie")
    both = with_once(both, "edited_spots", text_spots(F.col("edited")))
    return both.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("spots")).alias("fingerprint"), fingerprint(F.col("edited_spots")).alias("edited_fingerprint"),
        likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"),
        likeness(F.col("spots"), F.col("next_spots")).alias("near_next"),
    )


def op9_spot_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
