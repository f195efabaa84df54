"""Exact top-k inner products with two cover trees.

Vectors are dealt to cells around centres taken from a bounded sample, and cells are
cut into blocks of bounded size. Inside a block a cover tree splits points again and
again by nearest centre, each node with the exact radius that covers its points.
Queries are grouped the same way. The inner product of any query in one ball and any
vector in another is at most

    q.c + r_q |c| + r_c |q| + r_q r_c

so a pair of nodes below the query group's worst k-th score so far is pruned: first
whole cells, then blocks, then nodes of the two trees inside a pair of blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presslens.llm.common import arrow_rows, table
from presslens.session import written

K = 20
SCALE = 64
QUERY_STEP = 20
#: Vectors that the top of the tree is fitted on: those with the smallest id hash.
SAMPLE = 2048
CELLS = 24
#: About how many vectors a block holds, and points of a leaf.
BLOCK = 4096
LEAF = 256
EXACT = 2.0 ** 53


class Node(NamedTuple):
    centre: np.ndarray
    norm: float
    radius: float
    points: np.ndarray
    children: list


def farthest_first(x: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` distinct points, each the farthest from those before it."""
    chosen, far = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < most and far.max() > 0:
        chosen.append(int(far.argmax()))
        np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1), out=far)
    return np.array(chosen)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres ** 2).sum(1) - 2 * (x @ centres.T)).argmin(1)


def cover_tree(x: np.ndarray, points: np.ndarray | None = None, leaf: int = LEAF) -> Node:
    """Nodes by nearest centre; ``points`` of a node are in ascending order."""
    points = np.arange(len(x)) if points is None else points
    own = x[points]
    centre = own.mean(0)
    radius = float(np.sqrt(((own - centre) ** 2).sum(1).max()))
    children = []
    if len(points) > leaf and radius > 0:
        split = nearest(own, own[farthest_first(own, 8)])
        children = [cover_tree(x, points[split == c], leaf) for c in np.unique(split)]
        if len(children) < 2:
            children = []
    return Node(centre, float(np.linalg.norm(centre)), radius, points, children)


def bound(q: Node, d: Node) -> float:
    value = float(q.centre @ d.centre) + q.radius * d.norm + d.radius * q.norm + q.radius * d.radius
    return value + 1e-9 * abs(value) + 1e-3


class Best:
    """The k best candidates of each query; missing ones have the least score."""

    def __init__(self, n: int, k: int, least: np.ndarray):
        self.k, self.least = k, least.copy()
        self.found: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # heaps of (score, -id)

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        """Scores of ``rows`` x ``ids`` (ids ascending); ``own`` are the rows' ids."""
        mask = scores >= self.least[rows][:, None]
        mask &= own[:, None] != ids
        for i in np.flatnonzero(mask.any(1)):
            at = np.flatnonzero(mask[i])
            if len(at) > self.k:  # of the best k, ties to the smaller id
                s = scores[i, at]
                cut = np.partition(s, len(s) - self.k)[len(s) - self.k]
                ties = np.flatnonzero(s == cut)[: self.k]
                at = at[np.union1d(np.flatnonzero(s > cut), ties)]
            heap = self.found[rows[i]]
            for j in at:
                item = (int(scores[i, j]), -int(ids[j]))
                if len(heap) < self.k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
            if len(heap) == self.k:
                self.least[rows[i]] = max(self.least[rows[i]], heap[0][0])


def dual_search(q: np.ndarray, q_ids: np.ndarray, d: np.ndarray, d_ids: np.ndarray, k: int, least: np.ndarray) -> Best:
    """Best candidates of every query among ``d``; none below the query's ``least``."""
    whole = len(q) and len(d) and q.shape[1] * float(np.abs(q).max(initial=0)) * float(np.abs(d).max(initial=0)) < EXACT
    left, right = q.astype(np.float64), d.astype(np.float64)
    best = Best(len(q), k, least)
    if not len(q) or not len(d):
        return best
    start = cover_tree(left), cover_tree(right)
    heap = [(-bound(*start), 0, *start)]
    serial = 1
    while heap:
        negative, _, a, b = heapq.heappop(heap)
        if -negative < best.least[a.points].min():
            continue
        if not a.children and not b.children:
            if whole:
                scores = left[a.points] @ right[b.points].T
            else:
                scores = q[a.points].astype(np.int64) @ d[b.points].astype(np.int64).T
            best.offer(a.points, scores, d_ids[b.points], q_ids[a.points])
            continue
        split_b = b.children and (not a.children or b.radius >= a.radius)
        for pair in ([(a, c) for c in b.children] if split_b else [(c, b) for c in a.children]):
            most = bound(*pair)
            if most >= best.least[pair[0].points].min():
                heapq.heappush(heap, (-most, serial, *pair))
                serial += 1
    return best


def _matrix(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(packed, "<i8").reshape(n, -1)


def _dealt(centres: np.ndarray):
    dims = centres.shape[1]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).to_pylist()
            cells = [int(nearest(np.array([(v + [0] * dims)[:dims]], float), centres)[0]) for v in rows] if len(rows) < 2 else (
                nearest(np.array([(v + [0] * dims)[:dims] for v in rows], float), centres).tolist())
            packed = [np.array(v, "<i8").tobytes() for v in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cells, pa.int32()), pa.array(packed, pa.binary())], ["vec_id", "cell", "v"])

    return dealt


BLOCK_SCHEMA = "cell int, block long, n int, ids binary, m binary, centre binary, radius double"


def _block(group: pa.Table) -> pa.Table:
    ids = group.column("vec_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    vectors = [np.frombuffer(x, "<i8") for x in group.column("v").to_pylist()]
    width = max(map(len, vectors))
    m = np.zeros((len(ids), width), np.int64)
    for row, i in enumerate(order):
        m[row, :len(vectors[i])] = vectors[i]
    centre = m.mean(0)
    radius = float(np.sqrt(((m - centre) ** 2).sum(1).max()))
    one = lambda name: [group.column(name)[0].as_py()]
    return pa.table({
        "cell": pa.array(one("cell"), pa.int32()), "block": pa.array(one("block"), pa.int64()), "n": pa.array([len(ids)], pa.int32()),
        "ids": [ids[order].astype("<i8").tobytes()], "m": [m.tobytes()], "centre": [centre.astype("<f8").tobytes()], "radius": [radius],
    })


def _ball(centre: bytes, radius: float, width: int = 0) -> Node:
    c = np.frombuffer(centre, "<f8")
    c = np.pad(c, (0, max(0, width - len(c))))
    return Node(c, float(np.linalg.norm(c)), radius, np.zeros(0, int), [])


def _reaches(centres: np.ndarray):
    """Blocks to how far each reaches from its cell's centre."""

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                c = np.frombuffer(r["centre"], "<f8")
                own = np.zeros(max(len(c), centres.shape[1]))
                own[:centres.shape[1]] = centres[r["cell"]]
                own[:len(c)] -= c
                out.append(float(np.linalg.norm(own)) + r["radius"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["cell", "reach"])

    return reach


def _cells_left(balls: list[tuple[int, bytes, float]]):
    """Query blocks to the other cells whose ball can hold a better score."""

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept: list[list] = [[], []]
            for i, r in enumerate(batch.to_pylist()):
                for cell, centre, radius in balls:
                    width = max(len(r["q_centre"]), len(centre)) // 8
                    if cell != r["q_cell"] and bound(_ball(r["q_centre"], r["q_radius"], width), _ball(centre, radius, width)) >= r["floor"]:
                        kept[0].append(i)
                        kept[1].append(cell)
            some = batch.take(pa.array(kept[0], pa.int32()))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(kept[1], pa.int32())], [*some.schema.names, "cell"])

    return left


def _blocks_left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for r in batch.to_pylist():
            width = max(len(r["q_centre"]), len(r["centre"])) // 8
            keep.append(bound(_ball(r["q_centre"], r["q_radius"], width), _ball(r["centre"], r["radius"], width)) >= r["floor"])
        yield batch.select(["q_cell", "q_block", "cell", "block"]).filter(pa.array(keep, pa.bool_()))


FOUND_SCHEMA = "query_id long, vec_id long, score long"


def _searched(k: int):
    """Rows (query block, its thresholds or null, vector block) to the best of each query."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q, d = _matrix(r["q_m"], r["q_n"]), _matrix(r["m"], r["n"])
                width = max(q.shape[1], d.shape[1])
                q, d = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, d))
                q_ids, d_ids = np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["ids"], "<i8")
                least = np.full(len(q), -np.inf) if r["least"] is None else np.array(r["least"], float)
                best = dual_search(q, q_ids, d, d_ids, k, least)
                rows = [(int(q_ids[i]), -neg, s) for i, heap in enumerate(best.found) for s, neg in heap]
                if rows:
                    a, b, c = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, c)], ["query_id", "vec_id", "score"])

    return search


def whole_vectors(vectors: DataFrame, column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vec_id, q``: floor(scale * x) of every component, of vectors without null or non-finite ones."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    kept = vectors.where(F.col("vec_id").isNotNull() & F.col(column).isNotNull() & F.forall(column, lambda x: ok(x.cast("double"))))
    return kept.select("vec_id", F.transform(column, lambda x: F.floor(x.cast("double") * scale).cast("bigint")).alias("q"))


def top_k(vectors: DataFrame, is_query, k: int = K, block: int = BLOCK, cells: int = CELLS, sample: int = SAMPLE) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` best other rows.

    ``vectors`` has ``vec_id, q`` (whole numbers); ``is_query`` is a condition on
    ``vec_id``. Ties go to the smaller id; fewer rows than ``k`` give all. A row is no
    candidate of a query of its own id. A repeated id is one candidate for each of
    its rows, and one query, of the largest vector. Short vectors are filled up with
    zeros. Components must be below 2**31 in size for scores to fit a long. An empty
    table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    vectors = vectors.where(F.size("q") > 0).select("vec_id", "q")
    top = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "q").limit(sample).collect()  # ``sample`` rows
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not top:
        return empty
    width = max(len(r.q) for r in top)
    points = np.array([list(r.q) + [0] * (width - len(r.q)) for r in top], float)
    centres = points[farthest_first(points, cells)]

    rows = written(vectors.mapInArrow(_dealt(centres), "vec_id long, cell int, v binary"), "vectors")
    counts = {r.cell: r.n for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a cell
    held = F.element_at(F.array(*[F.lit(counts.get(c, 0)) for c in range(len(centres))]), F.col("cell") + 1)
    parts = F.greatest(F.lit(1), F.ceil(held / block))
    # equal ids with equal vectors may meet in one block, a common vector is spread by id
    blocked = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), parts).cast("long"))
    data = written(blocked.groupBy("cell", "block").applyInArrow(_block, BLOCK_SCHEMA), "blocks")
    asked = rows.where(is_query).groupBy("vec_id").agg(F.max(F.struct("v", "cell")).alias("r")).select("vec_id", "r.v", "r.cell")
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.greatest(F.lit(1), F.ceil(held / (4 * block)))).cast("long"))
    queries = written(asked.groupBy("cell", "block").applyInArrow(_block, BLOCK_SCHEMA), "query-blocks").select(
        F.col("cell").alias("q_cell"), F.col("block").alias("q_block"), F.col("n").alias("q_n"), F.col("ids").alias("q_ids"),
        F.col("m").alias("q_m"), F.col("centre").alias("q_centre"), F.col("radius").alias("q_radius"),
    )
    payload = data.select("cell", "block", "n", "ids", "m")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def searched(pairs: DataFrame, name: str) -> DataFrame:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        columns = pairs.select("q_n", "q_ids", "q_m", "least", "n", "ids", "m", "q_cell", "q_block", "cell", "block")
        dealt = columns.repartition(parts, "q_cell", "q_block", "cell", "block")
        with arrow_rows(spark, 4):  # a row is two blocks
            return written(dealt.mapInArrow(_searched(k), FOUND_SCHEMA), name)

    # first the cell of the queries themselves, for a worst score to prune by
    unknown = queries.withColumn("least", F.lit(None).cast("array<double>"))
    home = searched(unknown.join(payload, F.col("q_cell") == F.col("cell")), "found-home")
    kth = home.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("query_id", "score")
    floors = asked.select("vec_id", F.col("cell").alias("q_cell"), F.col("block").alias("q_block")).join(
        kth, F.col("vec_id") == F.col("query_id"), "left"
    ).select("q_cell", "q_block", F.struct("vec_id", F.coalesce(F.col("score").cast("double"), F.lit(float("-inf"))).alias("w")).alias("w"))
    floors = floors.groupBy("q_cell", "q_block").agg(F.min("w.w").alias("floor"), F.array_sort(F.collect_list("w")).alias("ws"))  # a block's
    floored = written(queries.join(floors.withColumn("least", F.col("ws.w")).drop("ws"), ["q_cell", "q_block"]), "query-floors")

    # then what pruning leaves of other cells and of their blocks
    sizes = data.select("cell", "block", "centre", "radius")
    reach = sizes.mapInArrow(_reaches(centres), "cell int, reach double").groupBy("cell").agg(F.max("reach").alias("reach")).collect()  # a row a cell
    balls = [(r.cell, centres[r.cell].astype("<f8").tobytes(), r.reach) for r in reach]
    groups = floored.select("q_cell", "q_block", "q_centre", "q_radius", "floor")
    cells_left = groups.mapInArrow(
        _cells_left(balls), "q_cell int, q_block long, q_centre binary, q_radius double, floor double, cell int")
    blocks_left = cells_left.join(sizes, "cell").mapInArrow(_blocks_left, "q_cell int, q_block long, cell int, block long")
    rest = searched(floored.join(blocks_left, ["q_cell", "q_block"]).join(payload, ["cell", "block"]), "found-rest")
    ranked = home.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op6_exact_top_k(spark, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, F.col("vec_id") % QUERY_STEP == 0)
