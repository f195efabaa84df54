"""Filter interaction audit: which documents five filters remove, in every order.

Method: one table of failing row keys per filter, stored once. The survivors of a
prefix of filters are the documents left-anti-joined with the failing keys of each
filter in it; there are only 2^5 such prefixes, whatever the order. A step's removals
(its prefix's survivors that fail its filter, the left-semi join of the two) are the
difference of its prefix's survivors and the next prefix's; its redundant rows (the
failing keys of its filter that an earlier filter removed) are the filter's failing
keys less those removals; its label losses are removals labelled good or toxic.
Counts per part and prefix are aggregated where the survivors are, so only one row
per part, prefix and task is shuffled; they are written by 16 small jobs (a prefix
without E and with it), so that no plan holds more than six joins. All joins are on the row key:
its exchanges are built once and reused, and a join's output is already partitioned
for the next one.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presslens.llm.common import WORD, table
from presslens.session import shared_folder, written

FILTERS = "ABCDE"
#: Fixed values of the contract: A: fewer words; B: share of distinct words in per
#: cent; C: share of upper-case letters in per cent; D: characters that fail a text.
FEWEST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_UPPER_PERCENT = 3
SYMBOLS = "[#$%&*|]"


def failures(docs: DataFrame) -> DataFrame:
    """``row, doc_id, part, sha, A, B, C, D`` of every document.

    ``row`` is a key of the row (repeated ids and texts stay apart), ``part`` the
    ``lang`` value (null: empty string), ``sha`` the SHA-256 of the text. A null
    text is an empty one: it fails A only. Other columns of ``docs`` are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), 0)
    upper = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.sha2(text, 256).alias("sha"),
        (F.size(words) < FEWEST_WORDS).alias("A"),
        (100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT_PERCENT * F.size(words)).alias("B"),
        (100 * upper > MOST_UPPER_PERCENT * F.length(text)).alias("C"),
        text.rlike(SYMBOLS).alias("D"),
    )


def failing_tables(rows: DataFrame) -> DataFrame:
    """``row, filter``: the keys that fail each filter, one table per filter value.

    E: the text of a smaller doc_id is the same; of a text the smallest id is found
    by a partial aggregate, so a text shared by a third of the rows is one row per
    task before the shuffle. A null id fails E never, and sets no bar for others.
    """
    smallest = rows.groupBy("sha").agg(F.min("doc_id").alias("smallest"))
    copies = (
        rows.where(F.col("doc_id").isNotNull()).select("row", "doc_id", "sha")
        .join(smallest, "sha").where(F.col("doc_id") > F.col("smallest"))
        .select("row", F.lit("E").alias("filter"))
    )
    flagged = [rows.where(F.col(f)).select("row", F.lit(f).alias("filter")) for f in FILTERS[:-1]]
    out = flagged[0]
    for more in [*flagged[1:], copies]:
        out = out.unionByName(more)
    return out


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``row, part, good, toxic`` (0/1): any label row of the id with quality 1, toxic 1."""
    marks = (
        labels.where(F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(
            F.max((F.col("quality") == 1).cast("int")).alias("good"),
            F.max((F.col("toxic") == 1).cast("int")).alias("toxic"),
        )
    )
    named = rows.where(F.col("doc_id").isNotNull()).select("row", "part", "doc_id").join(marks, "doc_id", "left")
    nameless = rows.where(F.col("doc_id").isNull()).select("row", "part", F.lit(None).cast("int").alias("good"), F.lit(None).cast("int").alias("toxic"))
    return named.select("row", "part", "good", "toxic").unionByName(nameless).select(
        "row", "part", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"),
    )


def _mask(letters: str) -> int:
    return sum(1 << FILTERS.index(c) for c in letters)


def survivors(docs: DataFrame, failing: dict[str, DataFrame], mask: int) -> DataFrame:
    """The documents that fail none of the filters in ``mask``: one left-anti join each."""
    out = docs
    for i, f in enumerate(FILTERS):
        if mask >> i & 1:
            out = out.join(failing[f], "row", "left_anti")
    return out


def _steps() -> list[tuple[str, int, str, int]]:
    """``filter_order, step, filter, prefix mask`` of all 120 orders: fixed, 600 rows."""
    out = []
    for order in permutations(FILTERS):
        text = "".join(order)
        for step, letter in enumerate(order, 1):
            out.append((text, step, letter, _mask(text[:step - 1])))
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order of the five filters and step: counts of what the step does.

    ``part, filter_order, step, filter, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley``. Every part (``lang`` value, null as '') has
    all 600 rows, zeros included; an empty table gives none. Nulls in ``text`` are
    empty texts, repeated rows count once each, and ``doc_id`` is read only by E and
    the labels. ``shapley`` is the filter's removals summed over all 120 orders.
    """
    spark = docs.sparkSession
    rows = written(failures(docs.select("doc_id", "text", "lang")), "audit-rows")
    fails = written(failing_tables(rows), "audit-failing")
    failing = {f: fails.where(F.col("filter") == f).select("row") for f in FILTERS}
    people = labelled(rows, labels.select("doc_id", "quality", "toxic"))

    # One small job a pair of prefixes (without and with E), each appended to one
    # table: the plan of all 32 at once holds hundreds of joins on the driver.
    counts = shared_folder(spark, "audit-counts")
    last = FILTERS[-1]
    for mask in range(1 << (len(FILTERS) - 1)):
        alive = survivors(people, failing, mask)
        both = None
        for more, kept in ((0, alive), (1 << len(FILTERS) - 1, alive.join(failing[last], "row", "left_anti"))):
            part = kept.groupBy("part").agg(
                F.lit(mask | more).alias("mask"), F.count("*").alias("n"), F.sum("good").alias("g"), F.sum("toxic").alias("t"),
            )
            both = part if both is None else both.unionByName(part)
        both.write.mode("append").parquet(counts)
    counted = spark.read.schema("part string, mask int, n long, g long, t long").parquet(counts)
    by_part = counted.groupBy("part").agg(
        F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "g", "t")))).alias("m"),
    )

    steps = F.array(*[
        F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(f).alias("filter"),
                 F.lit(p).alias("pre"), F.lit(1 << FILTERS.index(f)).alias("bit"))
        for o, s, f, p in _steps()
    ])

    def at(mask: Column, field: str) -> Column:
        return F.coalesce(F.element_at(F.col("m"), mask)[field], F.lit(0)).cast("long")

    every = (1 << len(FILTERS)) - 1
    s = F.col("s")
    out = by_part.select("part", "m", F.explode(steps).alias("s")).select(
        "part", s["filter_order"].alias("filter_order"), s["step"].alias("step"), s["filter"].alias("filter"),
        at(s["pre"].bitwiseOR(s["bit"]), "n").alias("kept"),
        (at(s["pre"], "n") - at(s["pre"].bitwiseOR(s["bit"]), "n")).alias("removed"),
        (at(F.lit(0), "n") - at(s["bit"], "n") - at(s["pre"], "n") + at(s["pre"].bitwiseOR(s["bit"]), "n")).alias("redundant"),
        (at(F.lit(every) - s["bit"], "n") - at(F.lit(every), "n")).alias("unique_fails"),
        (at(s["pre"], "g") - at(s["pre"].bitwiseOR(s["bit"]), "g")).alias("good_lost"),
        (at(s["pre"], "t") - at(s["pre"].bitwiseOR(s["bit"]), "t")).alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")).cast("long"))


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(CAST(lang AS VARCHAR), '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
lab AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (
  SELECT d.part, coalesce(lab.good, 0) AS good, coalesce(lab.toxic, 0) AS toxic,
    (CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false) THEN 16 ELSE 0 END) AS mask
  FROM d LEFT JOIN lab ON d.doc_id = lab.doc_id),
m AS (SELECT part, mask, count(*) AS n, sum(good) AS g, sum(toxic) AS x FROM f GROUP BY part, mask),
l AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(c, b)),
p AS (
  SELECT l1.c || l2.c || l3.c || l4.c || l5.c AS filter_order, [l1.b, l2.b, l3.b, l4.b, l5.b] AS bits
  FROM l l1, l l2, l l3, l l4, l l5 WHERE l1.b + l2.b + l3.b + l4.b + l5.b = 31),
s AS (
  SELECT filter_order, CAST(r.step AS INTEGER) AS step, bits[r.step] AS bit,
         coalesce(list_sum(bits[1:r.step - 1]), 0) AS pre
  FROM p, range(1, 6) r(step)),
c AS (
  SELECT pp.part, s.filter_order, s.step, s.bit,
    sum(CASE WHEN m.mask & (s.pre | s.bit) = 0 THEN m.n ELSE 0 END) AS kept,
    sum(CASE WHEN m.mask & s.pre = 0 AND m.mask & s.bit <> 0 THEN m.n ELSE 0 END) AS removed,
    sum(CASE WHEN m.mask & s.pre <> 0 AND m.mask & s.bit <> 0 THEN m.n ELSE 0 END) AS redundant,
    sum(CASE WHEN m.mask = s.bit THEN m.n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN m.mask & s.pre = 0 AND m.mask & s.bit <> 0 THEN m.g ELSE 0 END) AS good_lost,
    sum(CASE WHEN m.mask & s.pre = 0 AND m.mask & s.bit <> 0 THEN m.x ELSE 0 END) AS toxic_lost
  FROM (SELECT DISTINCT part FROM m) pp CROSS JOIN s JOIN m ON m.part = pp.part
  GROUP BY pp.part, s.filter_order, s.step, s.bit)
SELECT part, filter_order, step, substr(filter_order, step, 1) AS filter,
  CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM c
"""
