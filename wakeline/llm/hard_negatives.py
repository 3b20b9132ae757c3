"""Hard-negative mining with anchor spanning-tree bounds.

For each anchor: its positives are the other rows of its label that score highest; for each positive, hard negatives are the rows
of other labels that score highest between low % and high % of the positive's score.  A score is the inner product of vectors of integers,
floor(scale * component), and is exact.

Anchors are dealt into blocks of near ones (signs of random projections, then a range sort), and each block gets a minimum spanning
tree by Euclidean distance, built in a task of its own.  Anchors then go over all rows in chunks of bounded size, as a query set in
blocks; a task holds the chunk and walks each block's tree for a slice of its rows.  The root's scores are computed.  A child's score of a
row lies within its parent's, give or take edge length times the row's norm; where the parent's is itself a range, the range widens.  Only
rows whose range meets the child's window are scored again: above the least of the best so far, for positives; between the least that a
window can still use and the largest it allows, for negatives.  On copies and tight clusters most rows are never scored; where
vectors are all far apart, as edges are long, most are.

Each task keeps the best few of each anchor (and positive) and emits those; a rank over the tasks' rows gives the result.

Defined cases: rows with a null id or label, a null or empty vector, null or non-finite components, another length than the commonest,
or components so large that scores might not fit a long take no part; of rows with one id the least (label, vector) counts; ties go by
smaller id; an anchor without positives or negatives has no rows; a negative positive's window is empty; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wakeline.llm.scratch import Scratch
from wakeline.llm.vectors import common_length, finite, matrix, one_row_each
from wakeline.operators.ranges import row_numbers

#: Anchors of one tree, rows of a slice, and bytes of anchor vectors that go over the rows at once.
BLOCK, SLICE, CHUNK_BYTES = 1024, 2048, 16 << 20


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prim's order of the rows of x, each one's parent (a place in that order, -1 for the root), and the edge's length."""
    n = len(x)
    order, parent, edge = np.zeros(n, int), np.full(n, -1), np.zeros(n)
    near, by, open_ = np.full(n, np.inf), np.zeros(n, int), np.ones(n, bool)
    at = 0
    for k in range(n):
        order[k], open_[at] = at, False
        if k:
            parent[k], edge[k] = by[at], np.sqrt(near[at])
        gap = ((x - x[at]) ** 2).sum(axis=1)
        closer = open_ & (gap < near)
        near[closer], by[closer] = gap[closer], k
        if k + 1 < n:
            at = int(np.where(open_, near, np.inf).argmin())
    return order, parent, edge


class Best:
    """For each slot the `k` largest scores so far, ties by smaller id."""

    def __init__(self, slots: int, k: int, kind: type):
        self.k, self.score, self.id = k, np.full((slots, k), -np.inf, kind), np.full((slots, k), np.iinfo(np.int64).max)

    def offer(self, slot: int, score: np.ndarray, ids: np.ndarray) -> bool:
        score, ids = np.concatenate([self.score[slot], score]), np.concatenate([self.id[slot], ids])
        if len(score) > 4 * self.k:  # all that tie with the last one wanted stay
            some = score >= np.partition(score, len(score) - self.k)[len(score) - self.k]
            score, ids = score[some], ids[some]
        first = np.lexsort((ids, -score))[: self.k]
        self.score[slot], self.id[slot] = score[first], ids[first]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slot, score, id) of all that is held."""
        slot, place = np.nonzero(np.isfinite(self.score))
        return slot, self.score[slot, place].astype(np.int64), self.id[slot, place]


class Anchors:
    """A chunk of anchors in tree order, as arrays; parent is a place in these arrays."""

    def __init__(self, table: pa.Table, d: int, exact: bool):
        table = table.sort_by([("block", "ascending"), ("place", "ascending")])
        column = lambda c: table[c].to_numpy()
        self.id, self.label, self.edge = column("vec_id"), column("label"), column("edge")
        block, parent = column("block"), column("parent")
        _, start = np.unique(block, return_index=True)
        base = np.repeat(start, np.diff([*start, len(block)]))
        self.root, self.parent = parent < 0, np.where(parent < 0, -1, parent + base)
        self.stop = np.repeat([*start[1:], len(block)], np.diff([*start, len(block)]))
        x = matrix(table["x"].combine_chunks(), d) if table.num_rows else np.zeros((0, d))
        # scores beyond 2**53 are sums of longs, held where 64 bits are exact
        self.x, self.kind = (x, np.float64) if exact else (x.astype(np.int64), np.longdouble)
        self.rescored = 0

    def walk(self, x: np.ndarray, norms: np.ndarray, allowed, window, found) -> None:
        """found(anchor, rows, their exact scores) for all rows of x that allowed(anchor) and window(anchor) = (least, most) leave."""
        held: dict[int, list] = {}
        kids = np.bincount(self.parent[self.parent >= 0], minlength=len(self.id))
        x = x if self.x.dtype == float else x.astype(np.int64)
        for a in range(len(self.id)):
            if self.root[a]:
                low = (x @ self.x[a]).astype(self.kind)
                high, at = low.copy(), np.flatnonzero(allowed(a))
                exact = low[at]
                self.rescored += len(x)
            else:
                up = held[self.parent[a]]
                reach = self.edge[a] * norms * (1 + 1e-9) + 1
                low, high = up[0] - reach, up[1] + reach
                least, most = window(a)
                at = np.flatnonzero((high >= least) & (low <= most) & allowed(a))
                exact = ((x[at] if 2 * len(at) < len(x) else x) @ self.x[a]).astype(self.kind)
                exact = exact if len(exact) == len(at) else exact[at]
                low[at] = high[at] = exact
                self.rescored += len(at)
                up[2] -= 1
                if not up[2]:
                    del held[self.parent[a]]
            if kids[a]:
                held[a] = [low, high, kids[a]]
            if len(at):
                found(a, at, exact)


def _slices(batches, d: int):
    """(ids, labels, vectors, norms) of bounded slices of rows."""
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            s = b.slice(at, SLICE)
            x = matrix(s.column(2), d)
            yield s.column(0).to_numpy(), s.column(1).to_numpy(), x, np.sqrt((x * x).sum(axis=1))


def mine(
    docs: DataFrame,
    *,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    every: int = 50,
    scale: int = 256,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); anchors are the rows whose id `every` divides."""
    scratch = Scratch(docs.sparkSession, "negatives")
    rows = docs.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("v")))
    d = common_length(rows, "v")
    empty = docs.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not d:
        return empty
    largest = float(int((2**62 / d) ** 0.5))
    rows = rows.where((F.size("v") == d) & F.forall("v", lambda c: F.abs(c * scale) < largest))
    rows = one_row_each(rows, "vec_id").select("vec_id", "label", F.transform("v", lambda c: F.floor(c * scale).cast("double")).alias("x"))
    rows = scratch.save(rows, "rows")
    top = rows.agg(F.max(F.array_max(F.transform("x", F.abs)))).first()[0]
    if top is None:
        return empty
    exact = d * top * top < 2**53  # else products go by longs

    # blocks of near anchors, a spanning tree for each
    planes = np.random.default_rng(13).standard_normal((d, 12))

    def coded(batches):
        for b in batches:
            code = ((matrix(b.column(2), d) @ planes) > 0) @ (1 << np.arange(12))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code.astype(np.int64))], ["vec_id", "label", "x", "code"])

    anchors = rows.where(F.col("vec_id") % every == 0).mapInArrow(coded, "vec_id long, label long, x array<double>, code long")
    anchors = row_numbers(anchors, [F.col("code").asc(), F.col("vec_id").asc()], "number")
    anchors = anchors.select("vec_id", "label", "x", F.floor((F.col("number") - 1) / BLOCK).alias("block"))

    def tree(t: pa.Table) -> pa.Table:
        t = t.sort_by("vec_id")
        order, parent, edge = spanning_tree(matrix(t["x"].combine_chunks(), d))
        t = t.take(pa.array(order))
        for name, values in (("place", np.arange(len(order))), ("parent", parent.astype(np.int64)), ("edge", edge)):
            t = t.append_column(name, pa.array(values))
        return t

    trees = anchors.groupBy("block").applyInArrow(tree, "vec_id long, label long, x array<double>, block long, place long, parent long, edge double")
    trees = scratch.save(trees, "trees")
    blocks = trees.agg(F.max("block")).first()[0]
    if blocks is None:
        return empty
    step = max(1, CHUNK_BYTES // (8 * d * BLOCK))
    out = None
    for first in range(0, blocks + 1, step):  # a chunk of anchors goes over all rows
        chunk = trees.where(F.col("block").between(first, first + step - 1))
        part = scratch.save(_mine_chunk(rows, chunk, d, exact, positives, negatives, low, high), f"found-{first}")
        out = part if out is None else out.union(part)
    return out


def _mine_chunk(rows: DataFrame, chunk: DataFrame, d: int, exact: bool, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    context = rows.sparkSession.sparkContext
    anchors = Anchors(chunk.toArrow(), d, exact)  # at most CHUNK_BYTES of vectors
    sent = context.broadcast(anchors)

    def best_positives(batches):
        a = sent.value
        best = Best(len(a.id), positives, a.kind)
        for ids, labels, x, norms in _slices(batches, d):

            def found(k, at, score, ids=ids):
                some = score >= best.score[k, -1]
                if some.any():
                    best.offer(k, score[some], ids[at[some]])

            a.walk(x, norms, lambda k: (labels == a.label[k]) & (ids != a.id[k]), lambda k: (best.score[k, -1], np.inf), found)  # noqa: B023
        slot, score, other = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(a.id[slot]), pa.array(score), pa.array(other)], ["anchor_id", "score", "other"])

    rank = lambda keys, s, i: F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(s), i))
    got = rows.mapInArrow(best_positives, "anchor_id long, score long, other long")
    got = got.withColumn("rank", rank(["anchor_id"], "score", "other")).where(F.col("rank") <= positives).toArrow()  # positives a chunk's anchor
    place = {i: k for k, i in enumerate(anchors.id.tolist())}
    n = len(anchors.id)
    score, other = np.zeros((n, positives), object), np.zeros((n, positives), np.int64)
    least, most = np.full((n, positives), np.inf, anchors.kind), np.full((n, positives), -np.inf, anchors.kind)
    for i, s, o, r in zip(*(got[c].to_pylist() for c in ("anchor_id", "score", "other", "rank")), strict=True):
        k, r = place[i], r - 1
        score[k, r], other[k, r] = s, o
        least[k, r], most[k, r] = -(-low * s // 100), high * s // 100
    score = score.astype(np.int64)
    usable = least <= most
    sent_windows = context.broadcast((score, other, least, most, usable))

    def best_negatives(batches):
        a = sent.value
        score, other, least, most, usable = sent_windows.value
        best = Best(len(a.id) * positives, negatives, a.kind)
        floor = least.copy()  # what a window can still use
        tops, bottoms = most.max(axis=1), np.where(usable, floor, np.inf).min(axis=1)
        for ids, labels, x, norms in _slices(batches, d):

            def found(k, at, got, ids=ids):
                for p in np.flatnonzero(usable[k]):
                    some = (got >= floor[k, p]) & (got <= most[k, p])
                    if some.any():
                        slot = k * positives + p
                        best.offer(slot, got[some], ids[at[some]])
                        floor[k, p] = max(least[k, p], best.score[slot, -1])
                bottoms[k] = np.where(usable[k], floor[k], np.inf).min()

            a.walk(x, norms, lambda k: labels != a.label[k], lambda k: (bottoms[k], tops[k]), found)  # noqa: B023
        slot, got, ids = best.rows()
        k, p = slot // positives, slot % positives
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (a.id[k], other[k, p], score[k, p], ids, got)], ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    got = rows.mapInArrow(best_negatives, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    got = got.withColumn("rank", rank(["anchor_id", "positive_id"], "negative_score", "negative_id")).where(F.col("rank") <= negatives)
    return got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
