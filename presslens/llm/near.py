"""Near-duplicate documents by the exact Jaccard similarity of word n-grams.

1. Equal n-gram sets become one class; everything after works on classes.
2. Two sets that are similar enough share one of their first n-grams in any common
   order, if "first" covers what may differ. The order is rare before frequent, by a
   table of bounded size that counts all n-grams of all documents in hashed cells.
3. Rows (n-gram, set size, class) are sorted by n-gram and size. A run of one n-gram
   is compared in tiles: rows whose sizes are within the similarity of each other.
4. A pair must get past a bound from above: the bits that differ between two
   hashed bitmaps of the sets are at most the n-grams that differ; larger sets have
   wider bitmaps. What is left is decided by intersecting the sorted sets.

Long runs are compared in three rounds. The first links every row to its neighbours
and to the first row of its size band; a row that could be linked to no row beyond its
neighbours is done with it. The second links every other row to the one of another
group that its bitmap is nearest to; both give pairs in a number that grows with the
rows, and join groups of copies. The third compares all rows of a run that are not
joined by then, so no link between groups is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslens.llm.common import arrow_rows, shingle_sets, table, text_batches, text_slices
from presslens.session import written

#: Cells that count n-grams for the order, and bits of a class's bitmap.
CELLS = 1 << 17
BITS = 1024
#: Most bits of the wide bitmap that a class of more than ``BITS`` n-grams has besides.
WIDE_BITS = 1 << 16
#: Rows before a row that the first round compares it with.
NEIGHBOURS = 4
#: Rows before a row that are looked at one by one for whether it needs later rounds.
FAR = 32
TILE = 512
#: Most ids that are sent to every executor; more are joined by shuffling.
SENT_IDS = 500_000
#: About how many rows of edges or labels make a part.
PART_ROWS = 200_000


def overlap_needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Least intersection of sets of these sizes for 100 * both >= percent * union."""
    return -((-percent * (a + b)) // (100 + percent))


def _counted(k: int):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        for batch in batches:
            for _, data, at in text_slices(batch.column(0)):
                sets = shingle_sets(data, at, k)
                counts += np.bincount((np.concatenate(sets) >> np.uint64(47)).astype(np.int64), minlength=CELLS)
        some = np.flatnonzero(counts)
        for i in range(0, len(some), 16384):
            part = some[i:i + 16384]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(counts[part], pa.int64())], ["cell", "n"])

    return counted


def frequency_classes(docs: DataFrame, k: int) -> np.ndarray:
    """A small number per cell, larger for cells with more n-grams (four to an octave)."""
    rows = docs.select("text").mapInArrow(_counted(k), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # a row a cell
    counts = np.zeros(CELLS)
    counts[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return np.round(4 * np.log2(counts + 1)).astype(np.uint8)


SIGNATURE = "doc_id long, n int, class long, bits binary, wide binary, first array<long>"


def bitmap(s: np.ndarray, bits: int) -> bytes:
    """Per cell, whether an odd number of the n-grams fall in it."""
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def wide_bitmap(s: np.ndarray) -> bytes | None:
    """About a bit to an n-gram for sets that fill a bitmap of ``BITS``; others need none."""
    return bitmap(s, min(1 << (len(s) - 1).bit_length(), WIDE_BITS)) if len(s) > BITS else None


def folded(bitmaps: list[bytes], size: int) -> np.ndarray:
    """Bitmaps cut down to ``size`` bytes, as if made with so many: parts of a cell's parity add up."""
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(b, np.uint64).reshape(-1, size // 8), 0) for b in bitmaps])


def _signed(k: int, percent: int, classes: np.ndarray):
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, bits, wide, first = [], [], [], [], []
            for _, data, at in text_slices(batch.column(1)):
                for s in shingle_sets(data, at, k):
                    n = len(s)
                    sizes.append(n)
                    keys.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63))
                    bits.append(bitmap(s, BITS))
                    wide.append(wide_bitmap(s))
                    order = np.argsort(classes[(s >> np.uint64(47)).astype(np.int64)], kind="stable")
                    first.append(s[order[:n + (-percent * n // 100) + 1]].view(np.int64) if n else [])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(sizes, pa.int32()), pa.array(keys, pa.int64()),
                pa.array(bits, pa.binary()), pa.array(wide, pa.binary()), pa.array(first, pa.list_(pa.int64())),
            ], ["doc_id", "n", "class", "bits", "wide", "first"])

    return signed


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of sorted rows in parts that never cut a run of equal n-grams."""
    held: list[pa.RecordBatch] = []

    def whole(parts: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
        columns = pa.Table.from_batches(parts)
        return {c: columns.column(c).to_numpy() for c in columns.column_names}

    for batch in batches:
        if not batch.num_rows:
            continue
        grams = batch.column(0).to_numpy()
        last = int(np.searchsorted(grams, grams[-1], "left"))
        if last:
            yield whole([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        elif held and held[-1].column(0)[-1].as_py() != grams[0]:
            yield whole(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield whole(held)


def _admitted(n_a, n_b, at_a, at_b, percent: int) -> np.ndarray:
    """Sizes within the similarity, and room for the needed overlap from here on."""
    need = overlap_needed(n_a, n_b, percent)
    small, large = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    return (small * 100 >= large * percent) & (np.minimum(n_a - at_a, n_b - at_b) >= need)


def _beyond(n: np.ndarray, at: np.ndarray, place: np.ndarray, percent: int) -> np.ndarray:
    """Rows of sorted runs with an admitted one more than ``NEIGHBOURS`` away; a row with
    sizes within the similarity more than ``FAR`` away is taken for one without a look."""

    def near_in_size(rows: np.ndarray, d: int) -> np.ndarray:
        rows = rows[place[rows] >= d]
        return rows[n[rows - d] * 100 >= n[rows] * percent]

    later = near_in_size(np.arange(len(n)), NEIGHBOURS + 1)
    beyond = np.zeros(len(n), bool)
    for d in range(NEIGHBOURS + 1, FAR + 1):
        some = near_in_size(later, d)
        some = some[_admitted(n[some], n[some - d], at[some], at[some - d], percent)]
        beyond[some] = beyond[some - d] = True
    some = near_in_size(later, FAR + 1)
    beyond[some] = beyond[some - FAR - 1] = True
    return np.flatnonzero(beyond)


FOUND = "a long, b long, n_a int, n_b int, gram long, at int"


def _first_round(percent: int):
    """Pairs with neighbours and band heads; rows that may have links beyond their
    neighbours come along with null ``b``."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            gram, n, own, at = rows["gram"], rows["n"].astype(np.int64), rows["class"], rows["at"].astype(np.int64)
            starts = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
            lengths = np.diff(np.r_[starts, len(gram)])
            run = np.repeat(np.arange(len(starts)), lengths)
            place = np.arange(len(gram)) - starts[run]
            band = np.floor(np.log(np.maximum(n, 1)) / np.log(100 / percent) + 1e-9).astype(np.int64) if percent < 100 else n
            edge = np.r_[True, (gram[1:] != gram[:-1]) | (band[1:] != band[:-1])]
            head = np.maximum.accumulate(np.where(edge, np.arange(len(gram)), 0))
            i = np.concatenate([np.flatnonzero(place >= d) for d in range(1, NEIGHBOURS + 1)] + [np.flatnonzero(~edge)])
            j = np.concatenate([np.flatnonzero(place >= d) - d for d in range(1, NEIGHBOURS + 1)] + [head[~edge]])
            ok = _admitted(n[i], n[j], at[i], at[j], percent)
            i, j = i[ok], j[ok]
            a, b = np.minimum(own[i], own[j]), np.maximum(own[i], own[j])
            n_a, n_b = np.where(a == own[i], n[i], n[j]), np.where(a == own[i], n[j], n[i])
            kept = np.unique(np.column_stack([a, b, n_a, n_b]), axis=0) if len(a) else np.zeros((0, 4), np.int64)
            long = _beyond(n, at, place, percent)
            m, r = len(kept), len(long)
            none = np.ones(m + r, bool)
            none[:m] = False
            yield pa.RecordBatch.from_arrays([
                pa.array(np.r_[kept[:, 0], own[long]], pa.int64()),
                pa.array(np.r_[kept[:, 1], np.zeros(r, np.int64)], pa.int64(), mask=none),
                pa.array(np.r_[kept[:, 2], n[long]], pa.int32()),
                pa.array(np.r_[kept[:, 3], np.zeros(r, np.int64)], pa.int32()),
                pa.array(np.r_[np.zeros(m, np.int64), gram[long]], pa.int64()),
                pa.array(np.r_[np.zeros(m, np.int64), at[long]], pa.int32()),
            ], ["a", "b", "n_a", "n_b", "gram", "at"])

    return found


def _least_apart(pairs: np.ndarray) -> np.ndarray:
    """Of rows ``a, b, n_a, n_b, apart`` those that are the least apart of their a or b."""
    kept = []
    for end in (0, 1):
        order = np.lexsort((pairs[:, 1 - end], pairs[:, 4], pairs[:, end]))
        first = np.ones(len(order), bool)
        first[1:] = pairs[order[1:], end] != pairs[order[:-1], end]
        kept.append(order[first])
    return pairs[np.unique(np.concatenate(kept))]


def _later_round(percent: int, nearest: bool):
    """Pairs of a run in different groups, tile against tile of compatible sizes: all
    that the bitmaps do not rule out, or of each row the ``nearest`` one."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            gram, n, own, at, group = (rows[c] for c in ("gram", "n", "class", "at", "label"))
            n, at = n.astype(np.int64), at.astype(np.int64)
            bits = np.frombuffer(b"".join(rows["bits"]), np.uint64).reshape(-1, BITS // 64)
            out = []
            starts = np.r_[np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]]), len(gram)]
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                if (group[lo:hi] == group[lo]).all():
                    continue
                for p in range(lo, hi, TILE):
                    x = slice(p, min(p + TILE, hi))
                    for q in range(p, hi, TILE):
                        y = slice(q, min(q + TILE, hi))
                        if n[x][-1] * 100 < n[y][0] * percent:
                            break
                        ok = _admitted(n[x][:, None], n[y][None], at[x][:, None], at[y][None], percent)
                        ok &= group[x][:, None] != group[y][None]
                        i, j = np.nonzero(np.triu(ok, 1) if p == q else ok)
                        apart, may = _may_link(n[x][i], n[y][j], bits[x][i], bits[y][j], percent)
                        i, j = i[may], j[may]
                        some = np.column_stack([own[x][i], own[y][j], n[x][i], n[y][j], apart[may]])
                        out.append(_least_apart(some) if nearest else some)
            if out:
                pairs = np.concatenate(out)
                pairs = _least_apart(pairs) if nearest else pairs
                swap = pairs[:, 0] > pairs[:, 1]
                pairs[swap] = pairs[swap][:, [1, 0, 3, 2, 4]]
                pairs = np.unique(pairs, axis=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(pairs[:, 2], pa.int32()), pa.array(pairs[:, 3], pa.int32())],
                    ["a", "b", "n_a", "n_b"])

    return found


def _may_link(n_a: np.ndarray, n_b: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits that differ, and whether they leave room for the needed overlap."""
    apart = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
    return apart, apart <= n_a + n_b - 2 * overlap_needed(n_a, n_b, percent)


PAIR = "a long, b long, n_a int, n_b int, apart int"


def _bounded(percent: int):
    """Pairs that the bit counts of their bitmaps do not rule out, with the bits apart."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_pylist() for c in (4, 5))
            n_a, n_b = (batch.column(c).to_numpy().astype(np.int64) for c in (2, 3))
            apart, keep = np.zeros(len(x), np.int64), np.zeros(len(x), bool)
            sizes = np.array([min(len(a), len(b)) for a, b in zip(x, y, strict=True)])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                apart[at], keep[at] = _may_link(n_a[at], n_b[at], folded([x[i] for i in at], size), folded([y[i] for i in at], size), percent)
            out = pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(apart, pa.int32())], ["a", "b", "n_a", "n_b", "apart"])
            yield out.filter(pa.array(keep))

    return bounded


def _sets(k: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [s.tobytes() for _, data, at in text_slices(batch.column(0)) for s in shingle_sets(data, at, k)]
            keys = [xxhash.xxh3_64_intdigest(s) - (1 << 63) for s in out]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.binary())], ["class", "grams"])

    return sets


def _intersected(percent: int):
    """Pairs whose sorted sets intersect enough."""

    def intersected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (batch.column(c).to_numpy().astype(np.int64) for c in (2, 3))
            need = overlap_needed(n_a, n_b, percent)
            keep = []
            for x, y, least in zip(batch.column(4), batch.column(5), need, strict=True):
                both = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)])
                both.sort(kind="stable")
                keep.append(int((both[1:] == both[:-1]).sum()) >= least)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return intersected


def components(links: DataFrame) -> DataFrame:
    """``class, label`` of all ends of ``links`` (``a, b``); the label is the least of its group.

    Every node points to its least neighbour, pointers are followed, and the edges
    between what is left are the next, much smaller, graph; labels follow the pointers
    of all graphs at the end. Tables are written in as many parts as the edges fill.
    """
    edges = written(links.where(F.col("a") != F.col("b")).distinct(), "edges")
    n = edges.count()
    parts = 1 + n // PART_ROWS
    ends = edges.select(F.col("a").alias("class")).union(edges.select("b")).distinct()
    labels = ends.withColumn("label", F.col("class"))
    while n:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = written(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("to")).coalesce(parts), "pointers")
        for _ in range(2):
            to = to.join(to.select(F.col("node").alias("to"), F.col("to").alias("next")), "to").select("node", F.col("next").alias("to"))
        to = written(to.coalesce(parts), "pointers")
        moved = edges.join(to.select(F.col("node").alias("a"), F.col("to").alias("u")), "a").join(
            to.select(F.col("node").alias("b"), F.col("to").alias("v")), "b")
        moved = moved.where(F.col("u") != F.col("v")).select(F.col("u").alias("a"), F.col("v").alias("b")).distinct()
        edges = written(moved.coalesce(parts), "edges")
        labels = labels.join(to.select(F.col("node").alias("label"), "to"), "label", "left").select("class", F.coalesce("to", "label").alias("label"))
        n = edges.count()
    return written(labels.coalesce(parts), "labels")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (``class, label``) after more links between classes."""
    between = written(_labelled(links, labels).select(F.col("a_label").alias("a"), F.col("b_label").alias("b")), "between")
    n = between.count()
    if not n:
        return labels
    joined = components(between).withColumnsRenamed({"class": "old", "label": "new"})
    ends = between.select(F.col("a").alias("class")).union(between.select("b")).distinct().withColumn("label", F.col("class"))
    known = labels.union(ends.select("class", "label")).distinct()
    out = known.join(joined, F.col("label") == F.col("old"), "left").select("class", F.coalesce("new", "label").alias("label"))
    return written(out.coalesce(1 + (labels.count() + n) // PART_ROWS), "merged")


def _labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs with ``a_label, b_label``; a class without a link is its own label."""
    for end in ("a", "b"):
        named = labels.withColumnsRenamed({"class": f"{end}_class", "label": f"{end}_found"})
        pairs = pairs.join(named, F.col(end) == F.col(f"{end}_class"), "left").drop(f"{end}_class")
        pairs = pairs.withColumn(f"{end}_label", F.coalesce(f"{end}_found", end)).drop(f"{end}_found")
    return pairs


class Join:
    """The steps of one similarity join; see the module's text."""

    def __init__(self, docs: DataFrame, k: int, percent: int):
        if not 50 <= percent <= 100:
            raise ValueError("percent must be 50 to 100")
        self.spark, self.k, self.percent = docs.sparkSession, k, percent
        self.docs = docs.select("doc_id", "text")
        text_batches(self.spark)
        classes = frequency_classes(self.docs, k)
        self.signed = written(self.docs.mapInArrow(_signed(k, percent, classes), SIGNATURE), "signatures")
        known = self.signed.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
        copied = written(known.groupBy("class").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("class").alias("copied")), "copied")
        few = copied.count() <= SENT_IDS
        if few:
            copied = F.broadcast(copied)
        once = known.join(copied, F.col("class") == F.col("copied"), "left_anti").select("class", "doc_id", "n", "bits", "wide", "first")
        first = known.join(copied, F.col("class") == F.col("copied"), "left_semi").groupBy("class").agg(F.min(F.struct("doc_id", "n", "bits", "wide", "first")).alias("r"))
        first = written(first.select("class", "r.*"), "classes")
        # rows without a copy stay where they are: most signatures are neither moved nor written again
        self.classes = (once if few else written(once, "once")).unionByName(first)

    def parts(self) -> int:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def bounded(self, pairs: DataFrame, name: str) -> DataFrame:
        """What the bitmaps leave of candidate pairs."""
        bits = self.classes.select("class", F.coalesce("wide", "bits").alias("bits"))
        joined = pairs.join(bits.withColumnsRenamed({"class": "a", "bits": "x"}), "a").join(bits.withColumnsRenamed({"class": "b", "bits": "y"}), "b")
        with arrow_rows(self.spark, 2048):
            return written(joined.select("a", "b", "n_a", "n_b", "x", "y").mapInArrow(_bounded(self.percent), PAIR), name)

    def sets(self, pairs: DataFrame, name: str) -> DataFrame:
        """``class, grams`` of all ends of pairs, from their texts."""
        ends = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
        ids = written(self.classes.select("class", "doc_id").join(ends, "class"), name + "-ids")
        few = F.broadcast(ids.select("doc_id")) if ids.count() <= SENT_IDS else ids.select("doc_id")
        grams = self.docs.join(few, "doc_id", "left_semi").select("text").mapInArrow(_sets(self.k), "class long, grams binary")
        return written(grams.join(ids.select("class"), "class", "left_semi").dropDuplicates(["class"]), name + "-sets")

    def links(self, pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
        """Pairs whose sets intersect enough. A pair moves one set, the other is there."""
        full = pairs.join(sets.withColumnsRenamed({"class": "a", "grams": "x"}), "a").join(sets.withColumnsRenamed({"class": "b", "grams": "y"}), "b")
        with arrow_rows(self.spark, 512):
            return written(full.select("a", "b", "n_a", "n_b", "x", "y").mapInArrow(_intersected(self.percent), "a long, b long"), name)

    def absorbed(self, labels: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
        """``labels`` after all links among candidate pairs.

        Each class is first compared with the one that its bitmap is nearest to; pairs
        that this has joined need no comparing, and all others are compared after it.
        """
        left = self.bounded(pairs, name)
        sets = self.sets(left, name)
        nearest = left.groupBy("b").agg(F.min(F.struct("apart", "a", "n_a", "n_b")).alias("r")).select("r.a", "b", "r.n_a", "r.n_b")
        nearest = written(nearest, name + "-nearest")
        labels = merged(labels, self.links(nearest, sets, name + "-links"))
        rest = left.join(nearest.select("a", "b"), ["a", "b"], "left_anti")
        rest = written(_labelled(rest, labels).where(F.col("a_label") != F.col("b_label")), name + "-rest")
        return labels if rest.isEmpty() else merged(labels, self.links(rest, sets, name + "-more"))

    def sorted_runs(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(self.parts(), "gram").sortWithinPartitions("gram", "n", "class")

    def labels(self) -> DataFrame:
        """``class, label`` of every class with a link."""
        grams = self.classes.select("n", "class", F.posexplode("first").alias("at", "gram"))
        runs = self.sorted_runs(grams.select("gram", "n", "class", "at"))
        with arrow_rows(self.spark, 20_000):
            found = written(runs.mapInArrow(_first_round(self.percent), FOUND), "first-round")
        pairs = written(found.where(F.col("b").isNotNull()).select("a", "b", "n_a", "n_b").distinct(), "first-pairs")
        nothing = self.spark.createDataFrame([], "class long, label long")
        labels = self.absorbed(nothing, pairs, "first")

        rows = found.where(F.col("b").isNull()).select("gram", F.col("n_a").alias("n"), F.col("a").alias("class"), "at")
        for nearest, name in ((True, "second"), (False, "third")):
            grouped = rows.join(labels, "class", "left").join(self.classes.select("class", "bits"), "class")
            grouped = grouped.select("gram", "n", "class", "at", F.coalesce("label", "class").alias("label"), "bits")
            with arrow_rows(self.spark, 20_000):
                more = self.sorted_runs(grouped).mapInArrow(_later_round(self.percent, nearest), "a long, b long, n_a int, n_b int")
                more = written(more, f"{name}-round")
            more = written(more.distinct().join(pairs.select("a", "b"), ["a", "b"], "left_anti"), f"{name}-pairs")
            labels = self.absorbed(labels, more, name)
            pairs = pairs.unionByName(more)
        return labels

    def documents(self) -> DataFrame:
        own = self.classes.select("class", "doc_id").join(self.labels(), "class", "left").withColumn("label", F.coalesce("label", "class"))
        least = own.groupBy("label").agg(F.min("doc_id").alias("component_id"))
        named = own.join(least, "label").select("class", "component_id")
        rows = self.signed.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "class")
        return rows.join(named, "class", "left").select(
            "doc_id", "n_shingles",
            F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs`` (``doc_id, text``).

    Two documents are linked if 100 times the n-grams of ``k`` words in both are at
    least ``percent`` times those in either; a group is what links reach, named by its
    smallest id. A-Z count as a-z. A document of fewer than ``k`` words has one
    n-gram, its whole sequence; one without words, or with null text, has none and is
    a group of its own. Null ids are linked with nothing and have a null group.
    Repeated rows are one text. An empty table gives no rows. Other columns are not
    read.
    """
    return Join(docs, k, percent).documents()


def op8_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), k=3, percent=90)
