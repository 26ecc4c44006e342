"""Exact top-k by inner product with two cover trees walked together.

Vectors become whole numbers, ``floor(scale * x)``. Candidates are dealt into blocks and queries
into groups by a hash of their id; every block meets every group once, as rows of packed vectors. In a block, candidates and queries each form a cover tree (a node covers
its points within a radius, the radii halve from level to level). The walk starts with the pair of roots.
For query node ``q`` and candidate node ``c`` with centres and radii,

    ``q.c <= centre_q . centre_c + r_q |centre_c| + r_c |centre_q| + r_q r_c``

bounds every score below; a pair whose bound is under the worst kth score of the query
node is dropped. Pairs with high bounds go first. What is left of every query in every block is
merged by rank.

Scores are exact: leaves are multiplied in doubles while all sums stay below 2^53, else in
Python's whole numbers; a score beyond 64 bits fails the job.

* Vectors that are NULL, or hold a NULL or non-finite value, take no part, neither as query nor as candidate;
  so do rows with a NULL id. Vectors of different lengths are not compared; an empty vector
  scores 0 with other empty ones.
* Ties go to the smaller id. Repeated rows are candidates as often as they occur; a query is not its own candidate,
  and a row repeating the query's id is the query's own, so it is none either. A repeated query row is one query.
* An empty table gives an empty result. Only id and vector are read; no column can clash.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesync.llm import ships

ships(__name__)

SCALE = 256
K = 5
#: Candidates of a block, queries of a group.
BLOCK = 4096
GROUP = 512
#: Points of a leaf: below it distances cost more than products.
LEAF = 64
#: Children of a node at most; also no more than a quarter of its points.
FAN = 128
_EXACT = float(1 << 53)


class CoverTree:
    """Nodes over rows of ``points``: centre, covering radius, children or the rows of a leaf."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf = points, leaf
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.rows: list[np.ndarray] = []
        if len(points):
            every = np.arange(len(points))
            far = self._distances(0, every)
            self._grow(0, every, far)
        self.norm = np.sqrt((points[self.centre] ** 2).sum(1)) if self.centre else np.zeros(0)

    def _distances(self, centre: int, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.points[rows] - self.points[centre]) ** 2).sum(1))

    def _grow(self, centre: int, rows: np.ndarray, far: np.ndarray) -> None:
        stack = [(centre, rows, far, -1)]
        while stack:
            centre, rows, far, parent = stack.pop()
            node, radius = len(self.centre), float(far.max())
            self.centre.append(centre)
            self.radius.append(radius)
            self.children.append([])
            self.rows.append(rows)
            if parent >= 0:
                self.children[parent].append(node)
            if len(rows) <= self.leaf or radius == 0:
                continue
            # Children: centres more than half the radius apart, each with the points it is the first to cover.
            rest, rest_far, next_, found = rows, far, centre, []
            while len(rest) and len(found) < min(FAN, len(rows) // 4 + 1):
                own_far = rest_far if next_ == centre else self._distances(next_, rest)
                covered = own_far <= radius / 2
                found.append((next_, rest[covered], own_far[covered], node))
                rest, rest_far = rest[~covered], rest_far[~covered]
                if len(rest):
                    next_ = int(rest[rest_far.argmax()])
            # Points that no few balls of half the radius cover have no structure to prune by: they stay a leaf.
            if not len(rest):
                stack += found


def top_scores(
    queries: np.ndarray, query_ids: np.ndarray, right: "CoverTree", ids: np.ndarray, k: int, big: bool
) -> tuple[list[list[int]], list[list[int]]]:
    """For each query the ``k`` best scores and ids here, ties to smaller ids."""
    left, points, n = CoverTree(queries), right.points, len(queries)
    best = [[] for _ in range(n)]
    worst = np.full(n, -np.inf)

    def bound(q: int, c: int) -> float:
        centre = float(queries[left.centre[q]] @ points[right.centre[c]])
        slack = left.radius[q] * right.norm[c] + right.radius[c] * left.norm[q] + left.radius[q] * right.radius[c]
        # Rounded up: no sum of doubles here is off by more than this.
        return centre + slack + 1e-9 * (abs(centre) + slack + left.norm[q] * right.norm[c]) + 1e-6

    heap = [(-bound(0, 0), 0, 0)] if n and len(points) else []
    while heap:
        top, q, c = heapq.heappop(heap)
        if -top < worst[left.rows[q]].min():
            continue
        if left.children[q] and (not right.children[c] or left.radius[q] >= right.radius[c]):
            pairs = [(child, c) for child in left.children[q]]
        elif right.children[c]:
            pairs = [(q, child) for child in right.children[c]]
        else:
            _scan(left.rows[q], right.rows[c], queries, points, query_ids, ids, k, big, best, worst)
            continue
        for a, b in pairs:
            most = bound(a, b)
            if most >= worst[left.rows[a]].min():
                heapq.heappush(heap, (-most, a, b))
    scores = [[s for s, _ in b] for b in best]
    return scores, [[i for _, i in b] for b in best]


def _scan(rows, columns, queries, points, query_ids, ids, k, big, best, worst) -> None:
    """All products of two leaves; what beats the queries' worst goes into their lists."""
    if big:
        table = np.array([[sum(int(x) * int(y) for x, y in zip(queries[r], points[c])) for c in columns] for r in rows], object)
    else:
        table = queries[rows] @ points[columns].T
    own = query_ids[rows][:, None] == ids[columns][None, :]
    good = (table >= worst[rows][:, None]) & ~own
    for i in np.flatnonzero(good.any(1)).tolist():
        at = np.flatnonzero(good[i])
        if len(at) > k and not big:
            cut = np.partition(table[i][at], len(at) - k)[len(at) - k]
            at = at[table[i][at] >= cut]
        found = [(int(table[i][j]), int(ids[columns[j]])) for j in at.tolist()]
        row = rows[i]
        best[row] = sorted(best[row] + found, key=lambda x: (-x[0], x[1]))[:k]
        if len(best[row]) == k:
            worst[row] = best[row][-1][0]


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of each value as doubles, which hold them exactly; NULL unless all are finite."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # The sum of a double and zero turns -0.0 into 0.0.
    return F.when(usable, F.transform(vector, lambda x: F.rint(_floor(scale * x.cast("double"))) + 0.0))


def _floor(x: Column) -> Column:
    """Floor that stays a double: values of 2^53 and more are whole already."""
    return F.when(F.abs(x) < _EXACT, F.floor(x).cast("double")).otherwise(x)


def _packed(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row per key: the ids and the vectors of its rows, at most a block of them."""
    return rows.groupBy(*key).agg(F.collect_list(F.struct("id", "vector")).alias("rows"))


def search(
    vectors: DataFrame, is_query: Column, k: int = K, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` best candidates of each query row."""
    own = vectors.select(
        F.col(vec_id).cast("long").alias("id"), whole_numbers(F.col(vector), scale).alias("vector"), is_query.alias("is_query")
    ).filter("id is not null and vector is not null")
    own = own.withColumn("dim", F.size("vector"))
    sizes = own.agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).first()
    blocks, groups = -(-sizes["n"] // BLOCK) or 1, -(-sizes["q"] // GROUP) or 1

    salt = F.monotonically_increasing_id()
    candidates = own.withColumn("block", F.pmod(F.xxhash64("id", salt), F.lit(blocks)).cast("int"))
    queries = own.filter("is_query").dropDuplicates(["id"]).withColumn("group", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
    packed = _packed(queries, ["dim", "group"]).withColumnRenamed("rows", "queries")
    packed = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    blocks_ = _packed(candidates, ["dim", "block"]).withColumnRenamed("rows", "candidates")
    met = packed.join(blocks_.hint("merge"), ["dim", "block"]).select("queries", "candidates")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, ids = CoverTree(np.zeros((0, 0))), np.zeros(0, np.int64)
        for batch in batches:
            for place in range(batch.num_rows):
                query_ids, q = _matrix(batch.column(0)[place])
                new_ids, p = _matrix(batch.column(1)[place])
                # The merge join brings the groups of a block one after another.
                if not np.array_equal(new_ids, ids) or not np.array_equal(p, tree.points):
                    tree, ids = CoverTree(p), new_ids
                most = max(np.abs(q).max(initial=0), np.abs(p).max(initial=0))
                big = float(most) ** 2 * max(q.shape[1], 1) >= _EXACT / 2
                scores, found = top_scores(q, query_ids, tree, ids, k, big)
                counts = [len(s) for s in scores]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(query_ids, counts), pa.int64()),
                        pa.array([i for x in found for i in x], pa.int64()),
                        pa.array([s for x in scores for s in x], pa.int64()),
                    ],
                    ["query_id", "vec_id", "score"],
                )

    found = met.mapInArrow(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    ranked = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _matrix(rows: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    values = rows.values
    vectors = values.field("vector")
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return values.field("id").to_numpy(zero_copy_only=False), flat.reshape(len(values), -1 if len(flat) else 0)
