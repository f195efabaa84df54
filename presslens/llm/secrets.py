"""Secret scans: broad candidates, and a random forest that removes false positives.

A candidate is a run of key characters with a digit in it, or whatever is assigned to
a credential's name. The forest sees its
length, the changes of character kind in it, how much of it dictionary words cover,
whether it is part of a path, and the words beside it. It is fitted by Spark's own
classifier on a bounded table of labelled findings; its trees are then one column
expression, so a scan is a projection: texts never move.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presslens.functions.once import with_once
from presslens.llm.common import id_remainder, table
from presslens.session import written

KEY = r"A-Za-z0-9+/_.@-"
#: A run of key characters; '=' is padding at its end only, so a name before it is not part.
RUN = rf"(?<![{KEY}])(?=[A-Za-z+/_.@-]*[0-9])(?:[{KEY}]{{16,}}(?:={{1,2}}(?![={KEY}]))?|[{KEY}]{{14,15}}={{1,2}}(?![={KEY}]))"
#: A credential's name and an assignment sign, in the bounded form that a look back needs.
NAMED = (
    r"(?:(?i:token|secret|passw(?:or)?d|api.?key|access.?key|private.?key|client.?key|auth|credential|bearer)"
    r"[\w-]{0,64}[\"'`]?\s{0,16}[:=]{1,2}>?\s{0,16})"
)
#: What a name assigns: all between quotes, else all up to a blank; any length, any characters.
QUOTED = "|".join(rf"(?<={q})(?<={NAMED}{q})(?:\\.|[^{q}\\\r\n])+(?={q})" for q in "\"'`")
BARE = rf"(?<=[:=>\s\"'`])(?<=[:=]>?\s{{0,16}}[\"'`]?)(?<={NAMED}[\"'`]?)[^\s\"'`:=>]\S*"
CANDIDATE = rf"{QUOTED}|{BARE}|{RUN}"
MASK = "[SECRET]"
#: Code points of context on either side.
BEFORE, AFTER = 48, 16
#: Bounds of the labelled findings that a fit reads: planted rows, documents.
PLANTED = 6000
LABELLED_DOCS = 3000
TREES, DEPTH = 24, 6

#: Words that make up addresses, paths and identifiers.
DICTIONARY = (
    "example", "mail", "https?", "www", "index", "version", "license", "test", "user", "name", "file", "path", "image",
    "data", "static", "public", "home", "the", "and", "for", "with", "report", "page", "item", "build", "release",
)
CREDENTIAL = r"(?i)(token|secret|passw(or)?d|api.?key|access.?key|private.?key|client.?key|auth|credential|bearer)"
ASSIGNED = r"[:=]>?\s*[\"'`]?$"
NEUTRAL = r"(?i)(commit|sha-?[0-9]*|md5|checksum|hash|digest|etag|uuid|guid|version|card|phone|isbn|order|mail)\W*$"
CHANGES = "(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"


def _flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def features(value: Column, before: Column, after: Column) -> Column:
    """The forest's inputs, in a fixed order, as an array of doubles."""
    n = F.length(value)
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / n
    return F.array(
        n.cast("double"), share("[0-9]"), share("[A-Z]"), share("[a-z]"), share(CHANGES),
        F.size(F.array_distinct(F.split(value, ""))).cast("double"),
        1.0 - F.length(F.regexp_replace(F.lower(value), "|".join(DICTIONARY), "")) / n,
        share("[/.]"), share("[_=+-]"), _flag(F.contains(value, F.lit("@"))),
        _flag(value.rlike("^[0-9a-fA-F]+$")), _flag(value.rlike(r"^[0-9.-]+$")),
        _flag(before.rlike(r"[/.:@]$")), _flag(before.rlike(CREDENTIAL)), _flag(before.rlike(ASSIGNED)),
        _flag(before.rlike(NEUTRAL)), _flag(after.rlike("^[\"'`]")),
        share("[^A-Za-z0-9]"), _flag(value.rlike(r"[()\[\]{}<>*]")), share(r"\s"),
    )


def candidates(text: Column) -> Column:
    """``pieces`` of the text between candidates, and ``found`` (value, before, after)."""
    text = F.coalesce(text, F.lit(""))
    cut = F.struct(F.split(text, CANDIDATE, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(CANDIDATE), 0).alias("values"))

    def told(p: Column) -> Column:
        # a candidate may follow another at once: a long name, then its value
        return F.struct(p.pieces.alias("pieces"), F.transform(p.values, lambda v, i: F.struct(
            v.alias("value"),
            F.right(F.concat(F.coalesce(F.get(p.values, i - 1), F.lit("")), F.get(p.pieces, i)), F.lit(BEFORE)).alias("before"),
            F.left(F.get(p.pieces, i + 1), F.lit(AFTER)).alias("after"),
        )).alias("found"))

    # a lambda's argument is computed once, an expression each time it is named
    return F.transform(F.array(cut), told)[0]


def planted_texts(spark: SparkSession, n: int = PLANTED, start: int = 0) -> DataFrame:
    """``kind, text, value, label``: keys of usual forms in usual places, and what is taken for them."""
    digest = F.sha2(F.col("id").cast("string").cast("binary"), 256)
    mixed = F.regexp_replace(F.base64(F.unhex(F.sha2(digest.cast("binary"), 512))), "=", "A")
    some = F.pmod(F.xxhash64("id"), F.lit(7)).cast("int")
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), F.pmod(some, F.lit(len(xs))) + 1)
    number = F.translate(digest, "abcdef", "012345")
    kinds: Sequence[tuple[Column, Column, Column, int]] = (
        (F.substring(digest, 1, 40), pick('token = "', "token: '", 'SECRET="'), F.lit('" '), 1),
        (F.substring(digest, 1, 32), pick("api_key=", 'apikey: "', "API-KEY: ", "https://www.example.com/?token="), F.lit('"\n'), 1),
        (F.substring(mixed, 1, 40), pick("aws_secret_access_key = ", 'client_secret: "', "auth_token="), F.lit("\n"), 1),
        (F.concat(F.lit("AKIA"), F.upper(F.substring(digest, 1, 16))), pick("key id ", "access_key = ", '"'), F.lit('"'), 1),
        (F.concat(F.lit("ghp_"), F.regexp_replace(F.substring(mixed, 1, 36), "[+/]", "x")), pick("Bearer ", "token ", "auth: "), F.lit(" "), 1),
        (F.concat(F.substring(mixed, 1, 20), F.lit("7")), pick("password: ", "passwd=", 'PASSWORD = "'), F.lit('"'), 1),
        (F.concat(F.substring(mixed, 1, 4), F.lit("."), F.substring(number, 1, 2), F.lit("@mail"), F.substring(number, 3, 1), F.lit(".example.com")),
         pick("write to ", "contact ", "mail: ", "the "), F.lit(" "), 0),
        (F.substring(number, 1, 16), pick("card ", "phone: ", "of ", "account = "), F.lit(" "), 0),
        (F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12}).*$", "$1-$2-$3-$4-$5"), pick("id: ", "uuid=", 'guid = "'), F.lit(" "), 0),
        (F.substring(digest, 1, 40), pick("commit ", "sha1: ", "checksum = ", "merge of "), F.lit("\n"), 0),
        (F.concat(F.lit("static/image/"), F.substring(number, 1, 4), F.lit("/file"), F.substring(number, 5, 3), F.lit(".html")),
         pick("https://www.example.com/", "/home/", 'src="'), F.lit('"'), 0),
        (F.concat(F.lit("user_data_version_"), F.substring(number, 1, 4), F.lit("_report")), pick("def ", "name = ", "the "), F.lit(" "), 0),
        (F.concat(F.lit("of."), F.substring(number, 1, 2), F.lit("@mail"), F.substring(number, 3, 1), F.lit(".example.com")),
         pick("token ", "auth by ", "user = "), F.lit(" "), 0),
    )
    letters = F.translate(digest, "0123456789", "ghijklmnop")
    word = lambda at: F.substring(letters, at, 5)
    kinds = (
        *kinds,
        (F.concat(F.substring(mixed, 1, 5), F.lit("-"), F.substring(digest, 1, 2)), pick('password = "', "passwd=", "password: '"), F.lit(" "), 1),
        (F.concat(F.substring(mixed, 1, 8), pick("&", "!", "#", "%"), F.substring(digest, 1, 4)), pick("password=", 'secret: "', "DB_PASSWORD="), F.lit(" "), 1),
        (F.concat(word(1), F.lit("-"), word(6), F.lit("-"), word(11)), pick('passwd = "', "secret=", "password='"), F.lit(" "), 1),
        (F.concat(word(1), F.lit(" "), word(6), F.lit(" "), word(11), F.lit(" "), word(16)), pick('password = "', "secret: '"), F.lit(" "), 1),
        (F.substring(letters, 1, 32), pick("secret_key=", 'API_KEY: "', "auth_token = "), F.lit("\n"), 1),
        (pick("required", "optional", "please", "None", "null", "the", "is"), pick("password: ", "the secret: ", "token = ", "auth: "), F.lit(" "), 0),
        (pick("get_token(user)", "getpass()", "os.environ[name]", "${TOKEN}", "<your-token>", "********", "request.headers(name)"),
         pick("token = ", "password=", "secret: "), F.lit(" "), 0),
    )
    kind = F.pmod(F.col("id"), F.lit(len(kinds)))

    def chosen(at: int) -> Column:
        out = F.lit(kinds[0][at])
        for k, row in enumerate(kinds[1:], 1):
            out = F.when(kind == k, row[at]).otherwise(out)
        return out

    filler = pick("", "and so on. ", "x = 1\n", "as seen in the ", "to be ")
    opened = F.regexp_extract(chosen(1), "[\"'`]$", 0)  # what was opened is closed
    text = F.concat(filler, chosen(1), chosen(0), opened, F.when(opened != "", " ").otherwise(F.regexp_replace(chosen(2), "[\"'`]", " ")))
    return spark.range(start, start + n).select(
        kind.alias("kind"), text.alias("text"), chosen(0).alias("value"), chosen(3).cast("double").alias("label"))


def planted_findings(spark: SparkSession, n: int = PLANTED) -> DataFrame:
    """``value, before, after, label``: what a scan finds in planted texts; only a planted secret is one."""
    found = planted_texts(spark, n).withColumn("f", F.explode(candidates(F.col("text")).found))
    label = F.when(F.col("f.value") == F.col("value"), F.col("label")).otherwise(0.0)
    return found.select("f.value", "f.before", "f.after", label.alias("label"))


def corpus_findings(docs: DataFrame, most: int = LABELLED_DOCS) -> DataFrame:
    """Findings of at most ``most`` documents outside the held-out fold, with a label.

    The label is a rule's: a value assigned to a credential's name, no address and
    not a number alone. Only runs of key characters are labelled; the rule cannot
    tell a short or worded secret from a word. Documents with the smallest hash of the id are read.
    """
    ids = docs.where(F.col("doc_id").isNotNull() & (id_remainder(F.col("doc_id"), 3) != 1)).select("doc_id").distinct()
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")  # ``most`` ids
    found = texts.select(F.explode(candidates(F.col("text")).found).alias("f")).select("f.*")
    named = F.col("before").rlike(CREDENTIAL + r"[\w-]*[\"']?\s*" + ASSIGNED)
    plain = ~F.contains("value", F.lit("@")) & ~F.col("value").rlike(r"^[0-9.-]+$")
    return found.where(F.col("value").rlike(f"^{RUN}$")).withColumn("label", _flag(named & plain))


def grown(lines: list[str]) -> float | tuple:
    """One printed tree: a leaf's value, or feature, threshold and the branches at or below and above it."""
    line = lines.pop(0).strip()
    if line.startswith("Predict"):
        return float(line.split(":")[1])
    test = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line)
    if not test:
        raise ValueError(f"not a split: {line}")
    yes = grown(lines)
    lines.pop(0)  # Else
    return int(test[1]), float(test[2]), yes, grown(lines)


def laid_out(tree: float | tuple, depth: int) -> tuple[list[int], list[float], list[float]]:
    """Features and thresholds of a tree by level, then its leaves; a leaf above ``depth`` fills what is below it."""
    level, features, thresholds = [tree], [], []
    for _ in range(depth):
        level = [n if isinstance(n, tuple) else (0, 0.0, n, n) for n in level]
        features += [n[0] for n in level]
        thresholds += [n[1] for n in level]
        level = [branch for n in level for branch in n[2:]]
    return features, thresholds, level


def train(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH) -> str:
    """The forest as a SQL expression: the share of trees that call ``f.x`` a secret.

    Its trees are three constant arrays that a fold walks down, so the expression stays
    small however many splits they have; plans, which the driver copies often, hold it.
    """
    rows = written(labelled.select(features(F.col("value"), F.col("before"), F.col("after")).alias("x"), "label").coalesce(2), "findings")
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=11, featuresCol="v").fit(
        rows.withColumn("v", array_to_vector("x")))
    blocks = re.split(r"\n\s*Tree \d+ \(weight [^)]*\):\n", model.toDebugString)[1:]
    return walked([grown([line for line in b.splitlines() if line.strip()]) for b in blocks], max(depth, 1))


def walked(forest: list[float | tuple], depth: int) -> str:
    """The mean over trees of the leaf that ``f.x`` reaches, as a SQL expression."""
    parts = zip(*(laid_out(tree, depth) for tree in forest), strict=True)
    split, than, leaf = (f"cast(split('{' '.join(str(v) for values in p for v in values)}', ' ') as array<{kind}>)"
                         for p, kind in zip(parts, ("int", "double", "double"), strict=True))
    inner = 2 ** depth - 1
    node = f"t * {inner} + node"
    step = f"2 * node + if(f.x[{split}[{node}]] <= {than}[{node}], 1, 2)"
    walk = f"aggregate(sequence(1, {depth}), 0, (node, level) -> {step})"
    return f"aggregate(sequence(0, {len(forest) - 1}), 0D, (sum, t) -> sum + {leaf}[t * {inner + 1} + {walk} - {inner}]) / {len(forest)}D"


def scan(docs: DataFrame, forest: str, bar: float = 0.5) -> DataFrame:
    """``docs`` with ``findings`` and ``redacted``, the text with its secrets masked.

    A finding has ``value, start`` (code points before it), ``score`` and ``secret``
    (score at or above ``bar``). Null text: no findings, stays null. Empty text: no
    findings. Repeated rows are scanned alike, null ids too; an empty table gives no
    rows. A ``docs`` column named ``findings`` or ``redacted`` is replaced; a secret
    that follows no credential's name and sign is a candidate only with a digit and
    16 characters.
    """
    told = F.struct(F.col("cut.pieces").alias("pieces"), F.transform("cut.found", lambda f: F.struct(
        f.value.alias("value"), features(f.value, f.before, f.after).alias("x"))).alias("found"))
    base = docs.drop("findings", "redacted")
    cut = with_once(base, "cut", candidates(F.col("text")))
    rows = with_once(cut, "told", told)
    starts = F.aggregate(
        F.zip_with("told.pieces", F.col("told.found.value"), lambda p, v: F.struct(F.length(p).alias("p"), F.coalesce(F.length(v), F.lit(0)).alias("v"))),
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out")),
        lambda acc, x: F.struct((acc.at + x.p + x.v).alias("at"), F.concat(acc.out, F.array(acc.at + x.p)).alias("out")),
    ).out
    scored = F.expr(f"transform(told.found, f -> named_struct('value', f.value, 'score', {forest}))")
    rows = with_once(with_once(rows, "scored", scored), "starts", starts)
    findings = F.transform("scored", lambda f, i: F.struct(
        f.value.alias("value"), F.get(F.col("starts"), i).alias("start"), f.score.alias("score"), (f.score >= bar).alias("secret")))
    masked = F.array_join(F.transform("told.pieces", lambda p, i: F.concat(p, F.coalesce(
        F.when(F.get(F.col("scored"), i).score >= bar, MASK).otherwise(F.get(F.col("scored"), i).value), F.lit("")))), "")
    redacted = F.when(F.exists("scored", lambda f: f.score >= bar), masked).otherwise(F.col("text"))
    return rows.select(*[F.col(f"`{c}`") for c in base.columns], findings.alias("findings"), redacted.alias("redacted"))


def forest_of(docs: DataFrame) -> str:
    """The forest fitted on planted findings and on labelled ones of ``docs``."""
    planted = planted_findings(docs.sparkSession)
    return train(planted.unionByName(corpus_findings(docs)))


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Every candidate of every document, with its score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, forest_of(docs)).select("doc_id", F.posexplode("findings").alias("finding", "f"))
    return found.select(
        "doc_id", "finding", "f.start", F.length("f.value").cast("long").alias("length"),
        F.crc32(F.col("f.value").cast("binary")).alias("value_crc32"), "f.score", "f.secret",
    )
