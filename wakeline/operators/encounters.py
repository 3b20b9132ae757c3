"""Runs of steps in which two vessels are near each other.  Positions are dealt, pairs are not: all steps of a pair meet in one group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.functions import geo
from wakeline.scratch import Scratch

#: Degrees along a side of the squares that vessels are dealt by, and positions in a block of vessels of one square, about.
HOME, ROWS = 0.5, 250_000
#: Candidate pairs that a group looks at together.
CHUNK = 2_000_000
SCHEMA = "track_id string, track_id2 string, k0 long, k1 long, steps long, nm double, latitude double, longitude double"


def _best(a: np.ndarray, b: np.ndarray, k0: np.ndarray, k1: np.ndarray) -> np.ndarray:
    """Of each span (k0, k1) the rows with the first pair (a, b), and the first without a and without b of that one."""
    order = np.lexsort((b, a, k1, k0))
    span = np.cumsum(np.r_[True, (np.diff(k0[order]) != 0) | (np.diff(k1[order]) != 0)]) - 1
    top = np.searchsorted(span, np.arange(span[-1] + 1))
    kept = [top]
    for x in (a, b):
        lone = x[order[top]][span]
        others = np.flatnonzero((a[order] != lone) & (b[order] != lone))
        kept.append(others[np.unique(span[others], return_index=True)[1]])
    return order[np.unique(np.concatenate(kept))]


def _runs(t: pa.Table, same: bool, radius_nm: float, best: bool) -> Iterator[pa.RecordBatch]:
    """Runs of the pairs of a group: of its vessels (same), or of one with first and one without."""
    enc = t["track_id"].combine_chunks().dictionary_encode()
    order = pc.array_sort_indices(enc.dictionary)
    names, rank = enc.dictionary.take(order), np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    code = rank[enc.indices.to_numpy()]
    first, step, lat, lon = (t[c].to_numpy() for c in ("first", "step", "latitude", "longitude"))
    steps, at = np.unique(step, return_inverse=True)
    size = radius_nm / 29.9
    strip = np.floor(lon / size).astype(np.int64)
    strip -= strip.min() - 1
    lane = at * (strip.max() + 2) + strip
    low, reach = lat.min(), radius_nm / 60
    wide = np.ptp(lat) + 2 * reach + 1
    slack = 1e-9 + 8 * np.finfo(float).eps * (lane.max() + 2) * wide
    place, p, c = lane * wide + (lat - low), np.radians(lat), np.cos(np.radians(lat))
    left, right = (np.arange(len(code)),) * 2 if same else (np.flatnonzero(first), np.flatnonzero(~first))
    left, right = left[np.argsort(code[left], kind="stable")], right[np.argsort(place[right], kind="stable")]
    if not len(left) or not len(right):
        return
    lo, hi = (np.stack([np.searchsorted(place[right], place[left] + d * wide + e) for d in (-1, 0, 1)]) for e in (-reach - slack, reach + slack))
    many = np.cumsum((hi - lo).sum(axis=0))
    ends = np.flatnonzero(np.r_[np.diff(code[left]) != 0, True])  # the last position of each vessel
    done = 0
    while done < len(left):
        ahead = np.searchsorted(many[ends], (many[done - 1] if done else 0) + CHUNK, side="right") - 1
        ahead = max(ahead, np.searchsorted(ends, done))  # a vessel at least
        begin, done = done, int(ends[ahead]) + 1
        n = (hi - lo)[:, begin:done].ravel()
        i = left[np.repeat(np.tile(np.arange(begin, done), 3), n)]
        j = right[np.repeat(lo[:, begin:done].ravel() - np.cumsum(n) + n, n) + np.arange(n.sum())]
        if same:
            i, j = i[keep := code[i] < code[j]], j[keep]
        i, j = i[keep := np.abs(lon[i] - lon[j]) <= size], j[keep]
        h = np.sin((p[j] - p[i]) / 2) ** 2 + c[i] * c[j] * np.sin(np.radians(lon[j] - lon[i]) / 2) ** 2
        nm = 2 * geo.EARTH_M * np.arcsin(np.sqrt(np.minimum(1, h))) / geo.NM_M
        i, j, nm = i[keep := nm <= radius_nm], j[keep], nm[keep]
        if not len(i):
            continue
        i, j = np.where(code[i] < code[j], i, j), np.where(code[i] < code[j], j, i)
        pair = code[i] * len(names) + code[j]
        by = np.argsort(pair * len(steps) + at[i])
        i, nm, pair, k = i[by], nm[by], pair[by], steps[at[i[by]]]
        starts = np.flatnonzero(np.r_[True, (np.diff(pair) != 0) | (np.diff(k) > 2)])
        stops = np.r_[starts[1:], len(k)]
        count, k0, k1, (a, b) = stops - starts, k[starts], k[stops - 1], np.divmod(pair[starts], len(names))
        lasting = np.flatnonzero(5 * count >= 3 * (k1 - k0 + 1))  # at least 60 % of the steps
        if not len(lasting):
            continue
        if best:
            lasting = lasting[_best(a[lasting], b[lasting], k0[lasting], k1[lasting])]
        mean = [np.add.reduceat(x, starts)[lasting] / count[lasting] for x in (nm, lat[i], lon[i])]
        cols = [names.take(pa.array(a[lasting])), names.take(pa.array(b[lasting])), *map(pa.array, (k0[lasting], k1[lasting], count[lasting], *mean))]
        for m in range(0, len(lasting), 200_000):
            yield pa.RecordBatch.from_arrays([x.slice(m, 200_000) for x in cols], ["track_id", "track_id2", "k0", "k1", "steps", "nm", "latitude", "longitude"])


def encounters(positions: DataFrame, radius_nm: float, best: bool = False) -> DataFrame:
    """(track_id, track_id2, k0, k1, steps, nm, latitude, longitude): runs of steps in which two vessels are within radius_nm.

    A run tolerates one missing step and has at least 60 % of its steps; nm is the mean distance, latitude and longitude the mean place
    of the vessel with the smaller id.  positions: one (step, track_id, latitude, longitude) for each vessel and step; up to 60 degrees
    of latitude.  best: only the pairs of each span that best_of_spans() may need, from parts of the table.

    Vessels are dealt to blocks by their mean place.  A position goes to the pair of its block and each block with a vessel in a cell
    around, so that what is shuffled grows with the positions; a group finds its pairs in chunks and passes runs on as it goes.
    """
    scratch, size = Scratch(positions.sparkSession, "encounters"), radius_nm / 29.9
    at = scratch.save(positions.select(F.col("step").cast("long").alias("step"), "track_id", "latitude", "longitude").where("latitude is not null and longitude is not null"), "positions")
    home = at.groupBy("track_id").agg(F.floor(F.avg("latitude") / HOME).alias("_h"), F.floor(F.avg("longitude") / HOME).alias("_g"), F.count("*").alias("_n"))
    home = scratch.save(home, "homes")
    parts = home.groupBy("_h", "_g").agg(F.ceil(F.sum("_n") / ROWS).alias("_parts"))
    block = F.concat_ws("/", "_h", "_g", F.pmod(F.xxhash64("track_id"), F.col("_parts")))
    blocks = home.join(parts, ["_h", "_g"]).select("track_id", block.alias("block"))
    cells = at.join(blocks, "track_id").withColumns({"_i": F.floor(F.col("latitude") / size), "_j": F.floor(F.col("longitude") / size)})
    cells = scratch.save(cells, "cells")
    near = F.array(*[F.struct((F.col("_i") + a).alias("_i"), (F.col("_j") + b).alias("_j")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    around = cells.select("step", "_i", "_j", "block").distinct().select("step", F.col("block").alias("other"), F.inline(near)).distinct()
    rows = cells.join(around, ["step", "_i", "_j"])
    rows = rows.select(F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), (F.col("block") <= F.col("other")).alias("first"), "step", "track_id", "latitude", "longitude")

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _runs(pa.Table.from_batches(list(batches)), key[0] == key[1], radius_nm, best)

    # by number: groups are small beside what they make, and Spark would join tasks by what they read
    tasks = max(int(positions.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * positions.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(tasks, "a", "b").groupBy("a", "b").applyInArrow(run, SCHEMA)


def best_of_spans(positions: DataFrame, radius_nm: float) -> DataFrame:
    """(track_id, track_id2, k0, k1): of the runs of each span the first pair by id, and the first ones without either vessel of that one.

    Whatever single vessel is ruled out, the first pair that is left is among these three.  So it is of the three of each part of the
    table: a part's first pair without a vessel is one of the part's own.
    """
    runs = encounters(positions, radius_nm, best=True).select("k0", "k1", F.struct("track_id", "track_id2").alias("p"))
    runs = Scratch(positions.sparkSession, "spans").save(runs, "runs")
    top = runs.groupBy("k0", "k1").agg(F.min("p").alias("m"))
    without = lambda x: F.min(F.when((F.col("p.track_id") != x) & (F.col("p.track_id2") != x), F.col("p")))
    three = runs.join(top, ["k0", "k1"]).groupBy("k0", "k1").agg(F.min("p").alias("x"), without(F.col("m.track_id")).alias("y"), without(F.col("m.track_id2")).alias("z"))
    return three.select("k0", "k1", F.explode(F.array_distinct(F.array("x", "y", "z"))).alias("p")).where("p is not null").select("p.track_id", "p.track_id2", "k0", "k1")
