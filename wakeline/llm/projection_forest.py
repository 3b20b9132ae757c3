"""Approximate nearest neighbours by a forest of random-projection trees.

Trees are fitted on a bounded sample: a node splits its sample by the projection on a random direction, at the median.  All rows are
routed to a leaf of each tree.  A query goes through all trees with one priority queue: a node's priority is the smallest margin
by which the query lies on the node's side of the splits above it, the most promising node of any tree is opened next, and leaves are taken
until the rows in them reach a budget.  The rows of those leaves are scored exactly, in double precision, and the best k stay.

The budget isn't guessed: for a bounded sample of queries the true neighbours are found among all rows, and the budget is
the smallest that finds `recall` of them.  On data with structure that is a small part of the rows; on vectors without any (random
directions, whose neighbours are hardly nearer than the rest) it nears all of them, as for any index of this kind.

Work is dealt by (leaf, piece of its rows, block of its queries), each of bounded size, so a leaf that holds a third of all rows, or is visited
by most queries, is many tasks.  A task streams its rows against the queries of the group and keeps the best k of each query.

What reaches the driver: the sample, the trees, a count for each leaf, and the sample queries with their neighbours.

Defined cases: rows with a null id, or a vector that is null, empty, zero, holds null or non-finite components or is of another length than the
commonest take no part; of rows with one id the least vector counts; ties go by smaller id, copies of a query's vector are
candidates; a query gets all candidates if there are fewer than k; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wakeline.llm.scratch import Scratch
from wakeline.llm.vectors import common_length, finite, matrix, one_row_each

#: Rows of a piece of a leaf, queries of a block, rows scored at once, queries a task keeps the best of before it hands them on.
PIECE, QUERY_BLOCK, SLICE, KEPT = 2048, 1024, 2048, 1 << 16
#: Least rows of the sample in a leaf, so that splits mean something.
LEAST_SAMPLE = 16


@dataclass
class Forest:
    """Nodes of all trees: unit directions, offsets, and children, where -1 - c is leaf c; leaves are numbered over all trees."""

    planes: np.ndarray
    offsets: np.ndarray
    left: np.ndarray
    right: np.ndarray
    roots: list[int]
    leaves: int

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree, a column a tree."""
        out = np.empty((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            node = np.full(len(x), root)
            open_ = np.flatnonzero(node >= 0)
            while len(open_):
                at = node[open_]
                margin = (x[open_] * self.planes[at]).sum(axis=1) - self.offsets[at]
                node[open_] = np.where(margin >= 0, self.right[at], self.left[at])
                open_ = open_[node[open_] >= 0]
            out[:, t] = -1 - node
        return out

    def visit(self, margins: np.ndarray, sizes: np.ndarray, budget: float):
        """(leaf, rows of leaves before it) in the order of the shared queue, while those rows are fewer than the budget."""
        queue = [(-np.inf, root) for root in self.roots]
        heapq.heapify(queue)
        taken, left, right = 0, self.left, self.right
        while queue and taken < budget:
            worst, node = heapq.heappop(queue)
            if node < 0:
                size = sizes[-1 - node]
                if size:
                    yield -1 - node, taken
                    taken += size
                continue
            m = margins[node]
            heapq.heappush(queue, (max(worst, -m), int(right[node])))
            heapq.heappush(queue, (max(worst, m), int(left[node])))

    def margins(self, x: np.ndarray) -> np.ndarray:
        return x @ self.planes.T - self.offsets


def grow(x: np.ndarray, trees: int, leaf: int, seed: int = 17) -> Forest:
    """Trees over the distinct rows of x, down to leaves of at most `leaf` of them; one tree if that is a single leaf."""
    x = np.unique(x, axis=0) if len(x) else x
    random = np.random.default_rng(seed)
    planes, offsets, left, right, roots, leaves = [], [], [], [], [], 0

    def split(rows: np.ndarray) -> int:
        nonlocal leaves
        if len(rows) > leaf:
            for _ in range(3):
                way = random.standard_normal(x.shape[1])
                way /= np.linalg.norm(way)
                at = x[rows] @ way
                cut = np.median(at)
                if not (at < cut).any():
                    above = at[at > cut]
                    if not len(above):
                        continue
                    cut = above.min()
                me = len(planes)
                planes.append(way), offsets.append(cut), left.append(0), right.append(0)
                left[me], right[me] = split(rows[at < cut]), split(rows[at >= cut])
                return me
        leaves += 1
        return -leaves

    for _ in range(trees if len(x) > leaf else 1):
        roots.append(split(np.arange(len(x))))
    shape = (len(planes), x.shape[1] if x.ndim == 2 else 0)
    return Forest(np.array(planes).reshape(shape), np.array(offsets), np.array(left, int), np.array(right, int), roots, leaves)


class Nearest:
    """The best k rows of each query seen, by exact score, ties by smaller id."""

    def __init__(self, k: int):
        self.k, self.slot = k, {}
        self.ids, self.scores = np.zeros((0, k), np.int64), np.zeros((0, k))

    def slots(self, queries: np.ndarray) -> np.ndarray:
        out = np.array([self.slot.setdefault(q, len(self.slot)) for q in queries.tolist()], int)
        grown = len(self.slot) - len(self.ids)
        if grown > 0:
            more = max(grown, len(self.ids))
            self.ids = np.concatenate([self.ids, np.full((more, self.k), np.iinfo(np.int64).max)])
            self.scores = np.concatenate([self.scores, np.full((more, self.k), -np.inf)])
        return out

    def offer(self, queries: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """Score rows x against queries q; the product of matrices only tells which are scored exactly."""
        slots = self.slots(queries)
        rough = q @ x.T
        slack = 1e-12 * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max()
        least = self.scores[slots, -1]
        if len(ids) > self.k + 1:  # one of them may be the query's own row
            place = len(ids) - self.k - 1
            least = np.maximum(least, np.partition(rough, place, axis=1)[:, place])
        row, col = np.nonzero(rough >= (least - slack)[:, None])
        other = queries[row] != ids[col]
        row, col = row[other], col[other]
        for at in range(0, len(row), 1 << 16):
            r, c = row[at : at + (1 << 16)], col[at : at + (1 << 16)]
            self._merge(slots[r], ids[c], (q[r] * x[c]).sum(axis=1))

    def _merge(self, slot: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        mine = np.unique(slot)
        slot = np.concatenate([slot, np.repeat(mine, self.k)])
        ids = np.concatenate([ids, self.ids[mine].ravel()])
        scores = np.concatenate([scores, self.scores[mine].ravel()])
        order = np.lexsort((ids, -scores, slot))
        slot, ids, scores = slot[order], ids[order], scores[order]
        new = np.ones(len(slot), bool)  # a row may come from several trees
        new[1:] = (slot[1:] != slot[:-1]) | (ids[1:] != ids[:-1])
        slot, ids, scores = slot[new], ids[new], scores[new]
        start = np.searchsorted(slot, slot)
        place = np.arange(len(slot)) - start
        first = place < self.k
        self.scores[mine], self.ids[mine] = -np.inf, np.iinfo(np.int64).max
        self.scores[slot[first], place[first]], self.ids[slot[first], place[first]] = scores[first], ids[first]

    def take(self) -> pa.RecordBatch:
        """(query_id, vec_id, score) of all that is held, which is forgotten."""
        queries = np.fromiter(self.slot, np.int64, len(self.slot))
        row, place = np.nonzero(np.isfinite(self.scores[: len(queries)]))
        out = [pa.array(queries[row]), pa.array(self.ids[row, place]), pa.array(self.scores[row, place])]
        self.__init__(self.k)
        return pa.RecordBatch.from_arrays(out, ["query_id", "vec_id", "score"])


def _best(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


FOUND = "query_id long, vec_id long, score double"


def exact(rows: DataFrame, queries: pa.Table, d: int, k: int) -> DataFrame:
    """The true neighbours of a bounded number of queries: every task scores its rows against all of them."""
    sent = rows.sparkSession.sparkContext.broadcast((queries["vec_id"].to_numpy(), matrix(queries["v"].combine_chunks(), d)))

    def run(batches):
        ids, q = sent.value
        best = Nearest(k)
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                s = b.slice(at, SLICE)
                best.offer(ids, q, s.column(0).to_numpy(), matrix(s.column(1), d))
        yield best.take()

    return _best(rows.mapInArrow(run, FOUND), k)


def _part(rows: DataFrame, n: int, most: int, salt: int) -> pa.Table:
    """About `most` of the n rows, by hash; all, if there are no more."""
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64(F.lit(salt), F.col("vec_id")), F.lit(1 << 40)) < int((1 << 40) * most / n))
    return rows.orderBy("vec_id").toArrow()


def nearest(
    docs: DataFrame,
    *,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    every: int = 20,
    k: int = 20,
    trees: int = 4,
    leaf_rows: int = 1024,
    sample: int = 16384,
    sample_queries: int = 128,
    recall: float = 0.95,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product found for each row whose id `every` divides."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "forest")
    rows = docs.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & finite(F.col("v")) & F.exists("v", lambda c: c != 0))
    d = common_length(rows, "v")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not d:
        return empty
    rows = scratch.save(one_row_each(rows.where(F.size("v") == d), "vec_id").select("vec_id", "v"), "rows")
    queries = rows.where(F.col("vec_id") % every == 0)
    n, asked = rows.count(), queries.count()
    if not asked:
        return empty

    fitted = _part(rows, n, sample, 1)
    forest = grow(matrix(fitted["v"].combine_chunks(), d), trees, max(LEAST_SAMPLE, leaf_rows * len(fitted) // n))
    sent = spark.sparkContext.broadcast(forest)

    def counted(batches):
        f = sent.value
        total = np.zeros(f.leaves, np.int64)
        for b in batches:
            total += np.bincount(f.route(matrix(b.column(1), d)).ravel(), minlength=f.leaves)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["leaf", "size"])

    sizes = np.zeros(forest.leaves, np.int64)
    for leaf, size in rows.mapInArrow(counted, "leaf long, size long").groupBy("leaf").agg(F.sum("size")).collect():  # a row a leaf
        sizes[leaf] = size
    budget = _budget(forest, sizes, rows, _part(queries, asked, sample_queries, 2), d, k, recall)

    def visits(batches):
        f = sent.value
        for b in batches:
            x = matrix(b.column(1), d)
            row, leaf = [], []
            for at in range(0, len(x), 256):
                for i, margins in enumerate(f.margins(x[at : at + 256])):
                    found = [c for c, _ in f.visit(margins, sizes, budget)]
                    leaf += found
                    row += [at + i] * len(found)
                if len(leaf) > 1 << 14 or at + 256 >= len(x):
                    part = b.take(pa.array(row, pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), part.column(0), part.column(1)], ["leaf", "id", "v"])
                    row, leaf = [], []

    asks = scratch.save(queries.mapInArrow(visits, "leaf long, id long, v array<double>"), "visits")
    visited = asks.groupBy("leaf").count().collect()  # a row a leaf
    plan = spark.createDataFrame([(r["leaf"], -(-int(sizes[r["leaf"]]) // PIECE), -(-r["count"] // QUERY_BLOCK)) for r in visited], "at long, pieces long, blocks long")

    def routed(batches):
        f = sent.value
        for b in batches:
            leaves = f.route(matrix(b.column(1), d))
            for t in range(leaves.shape[1]):
                yield pa.RecordBatch.from_arrays([pa.array(leaves[:, t].copy()), b.column(0), b.column(1)], ["leaf", "id", "v"])

    def dealt(df: DataFrame, side: int, own: str, other: str, own_as: str, other_as: str) -> DataFrame:
        """Each row goes to its own part by hash, and to all parts of the other side."""
        df = df.join(F.broadcast(plan), F.col("leaf") == F.col("at"))  # a row a leaf
        df = df.withColumn(own_as, F.pmod(F.xxhash64(F.lit(3), F.col("id")), F.col(own)))
        return df.withColumn(other_as, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))).select("leaf", "piece", "block", F.lit(side).alias("side"), "id", "v")

    both = dealt(asks, 0, "blocks", "pieces", "block", "piece").union(dealt(rows.mapInArrow(routed, "leaf long, id long, v array<double>"), 1, "pieces", "blocks", "piece", "block"))
    both = both.repartition("leaf", "piece", "block").sortWithinPartitions("leaf", "piece", "block", "side", "id")

    def scored(batches):
        best, group = Nearest(k), None
        ids, q = np.zeros(0, np.int64), np.zeros((0, d))
        for b in batches:
            key = np.stack([b.column(c).to_numpy() for c in range(4)], axis=1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            own, x = b.column(4).to_numpy(), matrix(b.column(5), d)
            for lo, hi in zip([0, *cuts], [*cuts, len(key)], strict=True):
                if hi == lo:
                    continue
                if tuple(key[lo, :3]) != group:
                    group, ids, q = tuple(key[lo, :3]), ids[:0], q[:0]
                    if len(best.slot) > KEPT:
                        yield best.take()
                if not key[lo, 3]:
                    ids, q = np.concatenate([ids, own[lo:hi]]), np.concatenate([q, x[lo:hi]])
                elif len(ids):
                    for at in range(lo, hi, SLICE):
                        best.offer(ids, q, own[at : min(hi, at + SLICE)], x[at : min(hi, at + SLICE)])
        yield best.take()

    return _best(both.mapInArrow(scored, FOUND), k)


def _budget(forest: Forest, sizes: np.ndarray, rows: DataFrame, queries: pa.Table, d: int, k: int, recall: float) -> int:
    """The rows to take so that `recall` of the sample queries' true neighbours lie in the leaves taken."""
    least = len(forest.roots) * (k + 1)
    if forest.leaves == 1 or not len(queries):
        return max(least, int(sizes.sum()))
    truth = exact(rows, queries, d, k).select("query_id", F.col("vec_id").alias("near"))
    truth = truth.join(rows, F.col("near") == F.col("vec_id")).select("query_id", "v").toArrow()  # k rows a sample query
    if not len(truth):
        return least
    place = {q: i for i, q in enumerate(queries["vec_id"].to_pylist())}
    margins = forest.margins(matrix(queries["v"].combine_chunks(), d))
    before = np.full((len(place), forest.leaves), np.iinfo(np.int64).max)
    for i in range(len(place)):
        for leaf, taken in forest.visit(margins[i], sizes, np.inf):
            before[i, leaf] = taken
    who = np.array([place[q] for q in truth["query_id"].to_pylist()])
    need = before[who[:, None], forest.route(matrix(truth["v"].combine_chunks(), d))].min(axis=1)
    return max(least, int(np.quantile(need, recall, method="higher")) + 1)
