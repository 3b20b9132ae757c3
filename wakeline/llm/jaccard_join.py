"""N-gram Jaccard self-join by adaptive multi-match prefixes, and the components of its links.

Each document is the set of its distinct n-word shingles.  Shingles have one global order, rarest first: by a sketch of how
many documents hold them (counts of all documents in fixed-size cells), then by hash; any fixed order keeps the join exact,
the counts only make it cheap.  A document of s shingles needs an overlap of at least ceil(threshold * s) with any partner, so
the first s - ceil(threshold * s) + l shingles of two linked documents share at least l: its l-match prefix.  A longer prefix
costs rows but asks more of a candidate, and each document takes the l of least estimated cost (its prefix's expected matches,
and the candidates left when l of them are needed).  A pair is a candidate if its prefixes share the smaller of the two l.

Documents with equal sets are one node.  Large groups of near copies have a number of links that grows with the square of
their size, so links inside a component that is already known are not asked for: first every node is held against a few
hub nodes of its prefix shingles, which joins the bulk of each group; then exactly the candidates between different components
are generated and verified.  For the few nodes that are left by then the exact number of holders of each shingle is counted: their
prefixes are drawn again in that order, and shingles that only one node has bound a pair's similarity from above, so that nodes and
pairs that can't reach the threshold leave before their sets are compared.

What is left of a large group are copies that drifted just beyond the threshold: they link with nothing, but nearly all of them share
nearly all their shingles, so a join on shingles makes all their pairs.  Such shingles get a pivot, a central node of the group, and
each node near it is described anew by its difference set: what it lacks of the pivot, and what it has besides.  Two nodes are as far
apart as their difference sets, and these have few elements in common.  A link of two nodes of which at most one is in the pivot's
component needs a large overlap of small difference sets, and so very short prefixes of them (`_difference_prefixes`).  By the triangle
inequality of the Jaccard distance a node near the pivot has all its partners among the nodes that are a little further, so it is
done with, and the shingle's other nodes go on to the next pivot.  Rounds go on while the pairs left outgrow the rows left (and up to
a number of rounds); what remains then is joined plainly.  No link between different components is lost, so the components are
those of all links.

All verification is exact, on whole sets (64-bit shingle hashes).  Fingerprints of sets are 128 bits.

Defined cases: a null or blank text has an empty set and links with nothing, not even with its like; a text with fewer than n
words has its whole sequence as its only shingle; repeated rows are copies and link; rows with a null doc_id
link like others and have a row each, whose class_id and component_id are null where no row with an id is reached; of rows that repeat a doc_id any one's links count for it; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm import textops as T
from wakeline.llm.graph import components
from wakeline.llm.scratch import Scratch

#: Cells of the document-frequency sketch, a fixed size whatever the input.
CELLS = 1 << 18
SLICE = 1 << 13
SHARES = 256
#: How many prefix shingles must match, as shares of a document's size: the least asked for, and what costly documents go up to.
LEVELS = (0.05, 0.10, 0.20)
#: A node of at least this similarity (as a percentage) to its shingle's pivot is done with it.
NEAR = 50


def _matches(s: int, level: float) -> int:
    return 1 + int(s * level)


def _sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingle hashes, for each row."""
    for c in T.chunks(column):
        words, rows = T.word_hashes(c, fold=True)
        grams, at = T.shingles(words, rows, n)
        for i in range(c.hi - c.lo):
            g = grams[at[i] : at[i + 1]]
            if len(g) > 1:
                g = np.sort(g)
                keep = np.empty(len(g), bool)
                keep[0] = True
                np.not_equal(g[1:], g[:-1], out=keep[1:])
                g = g[keep]
            yield c.lo + i, g


def _frequency_sketch(docs: DataFrame, n: int) -> np.ndarray:
    """For each cell, how many (document, shingle) pairs of all documents fall in it."""

    def count(batches):
        total = np.zeros(CELLS, np.int64)
        for b in batches:
            for c in T.chunks(b.column(0)):
                words, rows = T.word_hashes(c, fold=True)
                grams, _ = T.shingles(words, rows, n)
                total += np.bincount((grams >> np.uint64(46)).astype(np.int64), minlength=CELLS)
        parts = total.reshape(-1, SLICE)
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([parts[i].tobytes() for i in used], pa.binary())], ["part", "counts"])

    def add(part):
        total = np.sum([np.frombuffer(x, np.int64) for x in part["counts"]], axis=0)
        return part.head(1).assign(counts=[total.tobytes()])

    # added up in two levels, so that a group holds a share of the tasks' cells and then one array of each share
    counts = docs.select("text").mapInArrow(count, "part int, counts binary").withColumn("share", F.spark_partition_id() % SHARES)
    for keys, schema in ((("part", "share"), "part int, counts binary, share int"), (("part",), "part int, counts binary, share int")):
        counts = counts.groupBy(*keys).applyInPandas(add, schema)
    rows = counts.collect()  # CELLS numbers
    out = np.zeros((CELLS // SLICE, SLICE), np.int64)
    for r in rows:
        out[r.part] = np.frombuffer(r.counts, np.int64)
    return np.minimum(out.reshape(-1), 2**31 - 1).astype(np.int32)


def _described(docs: DataFrame, n: int, percent: int, sketch: np.ndarray) -> DataFrame:
    """(doc_id, n, k1, k2, l, prefix) for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    noise = float(np.median(sketch))

    def describe(batches):
        freq = shared.value
        for b in batches:
            m = len(b)
            size, k1, k2, ell, at, kept = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64), np.ones(m, np.int32), np.zeros(m + 1, np.int64), []
            for i, g in _sets(b.column(1), n):
                s = len(g)
                size[i] = s
                if s:
                    k1[i] = T.mix(g, 11).sum(dtype=np.uint64).view(np.int64)
                    k2[i] = T.mix(g, 12).sum(dtype=np.uint64).view(np.int64)
                    df = freq[(g >> np.uint64(46)).astype(np.int64)]
                    free = s - -(-s * percent // 100)  # shingles that a partner may lack
                    ells = [_matches(s, x) for x in LEVELS]
                    most = min(s, free + ells[-1])
                    first = np.arange(s)
                    if most < s:  # the shingles of the lowest frequencies, all of the last one
                        first = np.flatnonzero(df <= np.partition(df, most - 1)[most - 1])
                    order = first[np.lexsort((g[first], df[first]))][:most]
                    over = np.cumsum(np.maximum(df[order] - noise, 0))
                    costs = [over[min(s, free + x) - 1] * (1 + 2.0 / x) + 0.5 * (free + x) for x in ells]
                    ell[i] = ells[int(np.argmin(costs))]
                    take = order[: free + ell[i]]
                    kept.append(g[take])
                    at[i + 1] = len(take)
            flat = np.concatenate(kept) if kept else np.zeros(0, np.uint64)
            prefix = pa.ListArray.from_arrays(pa.array(np.cumsum(at), pa.int32()), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(k1), pa.array(k2), pa.array(ell), prefix], ["doc_id", "n", "k1", "k2", "l", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(describe, "doc_id long, n long, k1 long, k2 long, l int, prefix array<long>")


class _Sets:
    """Whole sets of nodes, of which a step on pairs moves only those that its pairs name."""

    def __init__(self, sets: DataFrame, scratch: Scratch, broadcast_rows: int):
        self.sets, self.scratch, self.bound, self.k = sets, scratch, broadcast_rows, 0

    def join(self, pairs: DataFrame, a: str, b: str) -> DataFrame:
        """pairs with the set of a as x and that of b as y.  The ids named are counted, and sent to all executors up to the bound."""
        self.k += 1
        pairs = self.scratch.save(pairs, f"pairs-{self.k}")
        ids = self.scratch.save(pairs.select(F.col(a).alias("rep")).union(pairs.select(b)).distinct(), f"ids-{self.k}")
        sets = self.sets.join(F.broadcast(ids), "rep", "left_semi") if ids.count() <= self.bound else self.sets
        left, right = sets.select(F.col("rep").alias(a), F.col("grams").alias("x")), sets.select(F.col("rep").alias(b), F.col("grams").alias("y"))
        return pairs.join(left, a).join(right, b).select(*pairs.columns, "x", "y")


def _verified(pairs: DataFrame, sets: _Sets, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets."""

    def hold(batches):
        for b in batches:
            left, right = b.column(2).values.to_numpy(), b.column(3).values.to_numpy()
            la, ra = b.column(2).offsets.to_numpy(), b.column(3).offsets.to_numpy()
            good = np.zeros(len(b), bool)
            for i in range(len(b)):
                x, y = left[la[i] : la[i + 1]].view(np.uint64), right[ra[i] : ra[i + 1]].view(np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                good[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(good))

    return sets.join(pairs, "a", "b").mapInArrow(hold, "a long, b long")


def _compared(pairs: DataFrame, sets: _Sets, least: int) -> DataFrame:
    """pairs (rep, hub, further columns) of a similarity of at least ``least`` percent, with their intersection's size and the
    elements that only one of them has."""

    kept = pairs.columns

    def compare(batches):
        for b in batches:
            x_, y_ = b.column(len(kept)), b.column(len(kept) + 1)
            left, right = x_.values.to_numpy(), y_.values.to_numpy()
            la, ra = x_.offsets.to_numpy(), y_.offsets.to_numpy()
            rows, common, parts = [], [], []
            for i in range(len(b)):
                x, y = left[la[i] : la[i + 1]].view(np.uint64), right[ra[i] : ra[i + 1]].view(np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                hit = y[at] == x
                both = int(hit.sum())
                if 100 * both >= least * (len(x) + len(y) - both):
                    rows.append(i)
                    common.append(both)
                    lacks = np.ones(len(y), bool)
                    lacks[at[hit]] = False
                    parts.append(np.concatenate([x[~hit], y[lacks]]).view(np.int64))
            some = b.take(pa.array(rows, pa.int64()))
            at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
            flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            arrays = [some.column(k) for k in range(len(kept))] + [pa.array(common, pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, "both", "d"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema.fields) + ", both long, d array<long>"
    return sets.join(pairs, "rep", "hub").mapInArrow(compare, schema)


def _difference_prefixes(near: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """From nodes near a pivot (hub, rep, n, m, own, c, inside, both, d): rows to probe with, and rows to hold them against.

    Two linked nodes differ in at most K = (100 - percent) * (n1 + n2) / (100 + percent) shingles, and so do their difference sets.
    Elements that no other difference set at the pivot has are surely among these.  The rest is ordered rarest first, and the first
    element that two nodes have in common stands early:
    of two nodes outside the pivot's component one has at most K / 2 elements that the other lacks, and the other at most K;
    a node inside it shares with any partner outside more than (|d| + (100 - percent) * (m - n) / (100 + percent)) / 2 elements.
    """
    far, whole = 100 - percent, 100 + percent
    tokens = near.select("hub", "rep", F.explode("d").alias("e"))
    held = tokens.groupBy("hub", "e").agg(F.count("*").alias("f")).where("f > 1")
    shared = tokens.join(held, ["hub", "e"]).groupBy("hub", "rep").agg(F.array_sort(F.collect_list(F.struct("f", "e"))).alias("x"))
    node = near.drop("d").join(shared, ["hub", "rep"]).withColumn("size", F.col("n") + F.col("m") - 2 * F.col("both")).withColumn("share", F.size("x"))
    most = F.floor(far * (F.col("n") + F.floor((F.col("n") - F.col("own")) * 100 / percent + 1e-9)) / whole + 1e-9)
    node = node.withColumn("k", most).withColumn("alone", F.col("size") - F.col("share"))
    overlap = F.floor((whole * F.col("size") + far * (F.col("m") - F.col("n"))) / (2 * whole) + 1e-9) + 1
    length = F.when(F.col("inside"), F.col("share") - overlap + 1).otherwise(F.floor(F.col("k") / 2) - F.col("alone") + 1)

    def rows(df: DataFrame, length) -> DataFrame:
        df = df.withColumn("take", F.least(length, F.col("share")).cast("int")).where("take > 0")
        return df.select("hub", "rep", "n", "c", "size", "share", F.posexplode(F.slice("x", 1, F.col("take"))).alias("pos", "y")).select("*", F.col("y.e").alias("e")).drop("y")

    return rows(node, length), rows(node.where("not inside"), F.col("k") - F.col("alone") + 1)


def _pivot_round(placed: DataFrame, sets: _Sets, percent: int, scratch: Scratch, k: int) -> tuple[DataFrame, DataFrame]:
    """The links of nodes near their shingle's pivot, and the rows of placed that are left."""
    central = F.struct(F.floor(10 * F.col("own") / F.col("n")).alias("o"), F.xxhash64("rep", F.lit(k)).alias("h"), "rep", "n", "own", "c")
    pivot = placed.groupBy("g").agg(F.min(central).alias("p"))
    pivot = pivot.select("g", F.col("p.rep").alias("hub"), F.col("p.n").alias("m"), F.col("p.own").alias("own2"), F.col("p.c").alias("hc"))
    rows = scratch.save(placed.join(pivot, "g"), f"pivots-{k}")
    p, q = F.col("n") - F.col("own"), F.col("m") - F.col("own2")
    least = NEAR - (100 - percent)  # what a partner of a node of similarity NEAR has at least
    fits = F.least(p, q) * 100 >= (F.greatest(p, q) + F.col("own") + F.col("own2")) * least
    pairs = rows.where((F.col("rep") != F.col("hub")) & fits).select("rep", "hub", "n", "m", "own", "c", "hc").distinct()
    near = _compared(pairs, sets, least)
    union = F.col("n") + F.col("m") - F.col("both")
    near = near.withColumn("linked", F.col("both") * 100 >= union * percent).withColumn("done", F.col("both") * 100 >= union * NEAR)
    near = near.withColumn("inside", F.col("linked") | (F.col("c") == F.col("hc")))
    near = scratch.save(near, f"near-{k}")
    probe, index = _difference_prefixes(near, percent)
    index = index.select("hub", "e", *[F.col(x).alias(f"{x}2") for x in ("rep", "n", "c", "size", "share", "pos")])
    overlap = F.least(F.col("share") - F.col("pos"), F.col("share2") - F.col("pos2"))
    enough = 2 * (100 + percent) * overlap >= (100 + percent) * (F.col("size") + F.col("size2")) - (100 - percent) * (F.col("n") + F.col("n2"))
    met = probe.join(index, ["hub", "e"]).where(enough & (F.col("c") != F.col("c2")) & (F.col("rep") != F.col("rep2")))
    met = met.select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b")).distinct()
    star = near.where("linked").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"))
    links = scratch.save(star.union(_verified(met, sets, percent)), f"near-links-{k}")
    gone = near.where("done").select("rep", "hub")
    left = rows.where("rep <> hub").join(gone, ["rep", "hub"], "left_anti").select(*placed.columns)
    left = scratch.save(left.join(_mixed(left), "g"), f"placed-{k + 1}")
    scratch.drop(f"pivots-{k}", f"near-{k}")
    return links, left


def _mixed(placed: DataFrame) -> DataFrame:
    """The shingles whose nodes lie in several components, one of the nodes being light."""
    return placed.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max("light").alias("some")).where("lo < hi and some").select("g")


def _pairs_left(placed: DataFrame) -> tuple[int, int]:
    """How many rows are left, and how many pairs of a light node with one of another component they make, each at each shingle."""
    parts = placed.groupBy("g", "c").agg(F.count("*").cast("double").alias("n"), F.count_if("light").alias("light"))
    sums = parts.groupBy("g").agg(F.sum("n").alias("n"), (F.sum("light") * F.sum("n") - F.sum(F.col("light") * F.col("n"))).alias("pairs"))
    n, pairs = sums.agg(F.sum("n"), F.sum("pairs")).first()
    return int(n or 0), int(pairs or 0)


def near_duplicates(docs: DataFrame, *, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", hubs: int = 8, pivots: int = 6, dense: float = 4.0, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) for each document.

    class_id is the smallest doc_id with the same set, component_id the smallest reachable by links; both are the document
    itself where its set is empty.  Two documents link if 100 * intersection >= percent * union.  The ids of nodes that can have a
    partner (8 bytes each) are counted, and sent to all executors up to broadcast_rows of them; beyond it the same join shuffles.
    pivots: rounds at most; dense: pairs a row at which another round is worth its cost.  Neither changes the result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    scratch = Scratch(spark, "jaccard")
    # rows without an id get one above all others, in a table that is written once, and lose it at the end
    top, nulls = docs.agg(F.coalesce(F.max("doc_id"), F.lit(0).cast("long")), F.count_if(F.col("doc_id").isNull())).first()
    if nulls:
        docs = scratch.save(docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(top) + 1 + F.monotonically_increasing_id())), "named")
    described = scratch.save(_described(docs, n, percent, _frequency_sketch(docs, n)), "described")

    # documents with equal sets are one node, named by the smallest doc_id
    full = described.where("n > 0")
    nodes = full.groupBy("k1", "k2", "n").agg(F.min(F.struct("doc_id", "l", "prefix")).alias("x"), F.count("*").alias("copies"))
    rows = nodes.select(F.explode("x.prefix").alias("g"), F.col("x.doc_id").alias("rep"), F.col("n").cast("int").alias("n"), F.col("x.l").alias("l"))
    shared = rows.groupBy("g").agg(F.count("*").alias("c")).where("c > 1").select("g")
    rows = scratch.save(rows.join(shared, "g"), "rows")
    # any partner of a node asks for at least the matches of the smallest size it can have
    enough = F.floor(F.ceil(F.col("n") * percent / 100.0 - 1e-9) * LEVELS[0]) + 1
    active = rows.groupBy("rep").agg(F.count("*").alias("c"), F.first("n").alias("n")).where(F.col("c") >= enough).select("rep")
    active = scratch.save(active, "active")
    near = F.broadcast(active) if active.count() <= broadcast_rows else active
    rows = rows.join(near, "rep")

    # whole sets of the nodes that are left
    def sets_of(batches):
        for b in batches:
            grams = [g for _, g in _sets(b.column(1), n)]
            at = np.concatenate([[0], np.cumsum([len(g) for g in grams])]).astype(np.int32)
            flat = np.concatenate(grams).view(np.int64) if grams else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["rep", "grams"])

    sets = docs.join(near.withColumnRenamed("rep", "doc_id"), "doc_id")
    sets = scratch.save(sets.select("doc_id", "text").mapInArrow(sets_of, "rep long, grams array<long>"), "sets")

    # among the nodes left, exact counts: own are shingles that no other node has.  No partner shares them, so a pair's similarity is
    # at most least(n - own) / (greatest(n - own) + both own); a node with many own needs a partner with few (light)
    tokens = sets.select(F.explode("grams").alias("g"), "rep")
    counts = scratch.save(tokens.groupBy("g").agg(F.count("*").alias("c")).where("c > 1"), "counts")
    shared = tokens.join(counts, "g").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("c", "g"))).alias("x"))
    facts = rows.groupBy("rep").agg(F.first("n").alias("n"))
    shared = shared.join(facts, "rep").withColumn("own", F.col("n") - F.size("x"))
    # the multi-match prefix again, in order of the exact counts; own shingles come first and need no row
    spare = F.col("n") - F.ceil(F.col("n") * percent / 100.0 - 1e-9).cast("int") - F.col("own")
    size = lambda m: F.least(F.size("x"), F.col("spare") + m)
    cost = lambda m: F.aggregate(F.slice("x", 1, size(m)), F.lit(0.0), lambda s, y: s + y["c"]) * (1 + 2.0 / m)
    options = [F.struct(cost(m).alias("cost"), m.alias("m")) for m in (F.lit(1), *[1 + F.floor(F.col("n") * x).cast("int") for x in LEVELS])]
    shared = shared.withColumn("spare", spare).where("spare >= 0 and size(x) > 0").withColumn("l", F.array_min(F.array(*options))["m"])
    rows = shared.select("rep", "n", F.col("own").cast("int").alias("own"), "l", F.explode(F.slice("x", 1, size(F.col("l")))).alias("y"))
    rows = rows.select("rep", "n", "own", "l", F.col("y.g").alias("g"))
    rows = rows.withColumn("light", (F.col("n") - F.col("own")) * 100 >= (F.col("n") + F.col("own")) * percent)
    rows = scratch.save(rows, "alive")

    sets = _Sets(sets, scratch, broadcast_rows)

    # hubs: of each shingle's nodes one light node, the same one for most shingles of a group of near copies
    p, q = F.col("n") - F.col("own"), F.col("m") - F.col("own2")
    fits = F.least(p, q) * 100 >= (F.greatest(p, q) + F.col("own") + F.col("own2")) * percent
    slot = F.pmod(F.col("g"), F.lit(hubs))
    hub = rows.where("light").groupBy("g").agg(F.min_by(F.struct("rep", "n", "own"), F.xxhash64("rep", slot)).alias("h"))
    hub = hub.select("g", F.col("h.rep").alias("hub"), F.col("h.n").alias("m"), F.col("h.own").alias("own2"))
    stars = rows.join(hub, "g").where((F.col("rep") != F.col("hub")) & fits)
    stars = stars.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
    links = scratch.save(_verified(stars, sets, percent), "stars")
    known = scratch.save(components(links, scratch, "first"), "known")

    # the rest: shingles whose nodes lie in several components, by pivots while the pairs outgrow the rows
    placed = rows.join(known.withColumnRenamed("node", "rep"), "rep", "left").withColumn("c", F.coalesce("component", "rep")).drop("component")
    placed = scratch.save(placed.join(_mixed(placed), "g"), "placed-0")
    for k in range(pivots if percent > 50 else 0):
        n_rows, n_pairs = _pairs_left(placed)
        if n_pairs <= dense * n_rows:
            break
        more, placed = _pivot_round(placed, sets, percent, scratch, k)
        scratch.drop(f"placed-{k}")
        links = links.union(more)
    # what remains, plainly: the pairs of a light node with one of another component
    light = placed.where("light")
    across = light.select("g", "c").distinct().join(placed.select("g", F.col("c").alias("d")).distinct(), "g").where("c <> d")
    one = across.join(light.select("g", "c", F.col("rep").alias("a"), "n", "l", "own"), ["g", "c"])
    two = placed.select("g", F.col("c").alias("d"), F.col("rep").alias("b"), F.col("n").alias("m"), F.col("l").alias("k"), F.col("own").alias("own2"), F.col("light").alias("light2"))
    once = ~F.col("light2") | (F.col("a") < F.col("b"))
    pairs = one.join(two, ["g", "d"]).where(fits & once).groupBy("a", "b").agg(F.count("*").alias("s"), F.first("l").alias("l"), F.first("k").alias("k"))
    pairs = pairs.where(F.col("s") >= F.least("l", "k")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = scratch.save(links.union(_verified(pairs, sets, percent)), "links")
    known = scratch.save(components(links, scratch, "all"), "components")
    scratch.drop("rows", "active", "sets", "counts", "alive", "stars", "known")

    # every document, by its class
    named = nodes.select("k1", "k2", F.col("n").alias("m"), F.col("x.doc_id").alias("class_id"))
    named = named.join(known, named["class_id"] == known["node"], "left").select("k1", "k2", "m", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    out = described.select("doc_id", "n", "k1", "k2")
    out = out.join(named.withColumnRenamed("k1", "q1").withColumnRenamed("k2", "q2"), (F.col("k1") == F.col("q1")) & (F.col("k2") == F.col("q2")) & (F.col("n") == F.col("m")), "left")
    ids = [F.col("doc_id"), F.coalesce("class_id", "doc_id"), F.coalesce("component_id", "doc_id")]
    if nulls:
        ids = [F.when(x <= top, x) for x in ids]
    return out.select(ids[0].alias("doc_id"), F.col("n").alias("n_shingles"), ids[1].alias("class_id"), ids[2].alias("component_id"))


def one_of_each(docs: DataFrame, *, broadcast_ids: int = 1_000_000, **options) -> DataFrame:
    """docs with one row of each group of near duplicates: the one of smallest doc_id, null last, of these by the row's hash.

    Rows are told apart even if they have no doc_id or share one: those get a key of their own, outside the range of all doc_ids, in a
    table that is written once.  The ids that repeat are counted, and sent to all executors up to broadcast_ids of them.  Documents
    with an empty set link with nothing and are kept.
    """
    scratch = Scratch(docs.sparkSession, "one_of_each")
    repeated = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_c")).where("_c > 1").select("_id")
    repeated = scratch.save(repeated, "repeated")
    n = repeated.count()
    low, high, nulls = docs.agg(F.min("doc_id").cast("long"), F.max("doc_id").cast("long"), F.count_if(F.col("doc_id").isNull())).first()
    if not n and not nulls:
        found = near_duplicates(docs, **options)
        gone = found.where("n_shingles > 0 and doc_id <> component_id").select(F.col("doc_id").alias("_id"))
        return docs.join(gone, docs["doc_id"] == gone["_id"], "left_anti")
    ids = F.broadcast(repeated) if n <= broadcast_ids else repeated
    key = F.monotonically_increasing_id()
    key = F.lit(low or 0) - 1 - key if (low or 0) > -(1 << 62) else F.lit(high) + 1 + key
    odd = docs.where("doc_id is null").unionAll(docs.join(ids, docs["doc_id"] == ids["_id"], "left_semi"))
    own = "_key"  # a name that no column of docs has
    while own in docs.columns:
        own += "_"
    odd = scratch.save(odd.withColumn(own, key), "odd")
    single = docs.where("doc_id is not null").join(ids, docs["doc_id"] == ids["_id"], "left_anti")
    found = near_duplicates(single.select("doc_id", "text").unionAll(odd.select(F.col(own), "text")), **options).where("n_shingles > 0")
    found = scratch.save(found.select(F.col("doc_id").alias("_id"), "component_id"), "found")
    # groups with such a row are put in order anew; the others' component_id is their smallest doc_id
    names = odd.select(F.col(own).alias("_key"), F.col("doc_id").alias("_own"), F.xxhash64(*docs.columns).alias("_hash"))
    named = found.join(names, found["_id"] == names["_key"], "left").withColumn("_own", F.when(F.col("_key").isNull(), F.col("_id")).otherwise(F.col("_own")))
    order = F.struct(F.col("_own").isNull().alias("none"), "_own", F.coalesce("_hash", F.lit(0)).alias("hash"), "_id")
    first = named.groupBy("component_id").agg(F.min(order).alias("_first"), F.count("_key").alias("_odd")).where("_odd > 0")
    first = first.select(F.col("component_id").alias("_component"), F.col("_first._id").alias("_kept"))
    gone = found.join(first, found["component_id"] == first["_component"], "left").where(F.col("_id") != F.coalesce("_kept", "component_id"))
    gone = scratch.save(gone.select("_id"), "gone")
    return single.join(gone, single["doc_id"] == gone["_id"], "left_anti").unionAll(odd.join(gone, odd[own] == gone["_id"], "left_anti").select(*docs.columns))
