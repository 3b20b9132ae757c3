"""Gatherings of vessels: components of near positions at each step, followed over steps as groups."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wakeline.functions import geo
from wakeline.operators import joins as J
from wakeline.operators.graph import components
from wakeline.scratch import Scratch


@dataclass(frozen=True)
class ClusterConfig:
    step_s: float = 300.0
    distance_nm: float = 3.0
    min_vessels: int = 4
    min_s: float = 2400.0
    max_kn: float = 4.0
    overlap: float = 0.5
    present: float = 0.5


#: Cells along a side of a tile.
TILE = 16


def _linked(a: np.ndarray, b: np.ndarray, distance_nm: float) -> bool:
    """Whether a place of a is within distance_nm of one of b (rows of latitude, longitude): nearest ones first, then all that can be."""

    def any_near(x: np.ndarray, y: np.ndarray) -> bool:
        for k in range(0, len(x), max(1, 1_000_000 // len(y))):
            (p1, l1), (p2, l2) = np.radians(x[k : k + max(1, 1_000_000 // len(y))]).T[:, :, None], np.radians(y).T[:, None, :]
            h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin((l2 - l1) / 2) ** 2
            if (2 * geo.EARTH_M * np.arcsin(np.sqrt(np.minimum(1, h))) / geo.NM_M <= distance_nm).any():
                return True
        return False

    if len(a) * len(b) > 1024:
        first = lambda x, y: x[np.argpartition(np.abs(x - y.mean(axis=0)).sum(axis=1), min(16, len(x) - 1))[:16]]
        if any_near(first(a, b), first(b, a)):
            return True
        reach = np.array([distance_nm / 59, distance_nm / 29])
        a = a[((a >= b.min(axis=0) - reach) & (a <= b.max(axis=0) + reach)).all(axis=1)]
        b = b[((b >= a.min(axis=0) - reach) & (b <= a.max(axis=0) + reach)).all(axis=1)] if len(a) else b
        a, b = np.unique(a, axis=0), np.unique(b, axis=0)
    return len(a) > 0 and len(b) > 0 and any_near(a, b)


def cell_links(points: DataFrame, distance_nm: float) -> DataFrame:
    """Edges (a, b) that join the nodes (cells of a step) whose positions hang together, at most one for each cell and tile that holds it.

    points: (step, node, _i, _j, latitude, longitude), any two positions of a cell within distance_nm of each other.  A tile sees its own
    cells and those around that its positions can reach; it compares cells, not positions, and only cells not yet joined by others.
    """
    at = F.array_distinct(F.array(*[F.struct(F.floor((F.col("_i") - a) / TILE).alias("_ti"), F.floor((F.col("_j") - b) / TILE).alias("_tj")) for a in (0, 2) for b in (-3, 0, 3)]))
    around = sorted(((a, b) for a in range(3) for b in range(-3, 4) if (a, b) > (0, 0)), key=lambda x: x[0] ** 2 + x[1] ** 2)

    def run(t):
        i, j = t["_i"].to_numpy(), t["_j"].to_numpy()
        order = np.lexsort((j, i))
        i, j = i[order], j[order]
        places = np.column_stack([t[c].to_numpy()[order] for c in ("latitude", "longitude")])
        starts = np.flatnonzero(np.r_[True, (np.diff(i) != 0) | (np.diff(j) != 0)])
        ends = np.r_[starts[1:], len(i)]
        cells = {c: k for k, c in enumerate(zip(i[starts].tolist(), j[starts].tolist(), strict=True))}
        root = list(range(len(starts)))

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = k = root[root[k]]
            return k

        for di, dj in around:
            for (ci, cj), k in cells.items():
                other = cells.get((ci + di, cj + dj))
                if other is None or (x := find(k)) == (y := find(other)):
                    continue
                if _linked(places[starts[k] : ends[k]], places[starts[other] : ends[other]], distance_nm):
                    root[max(x, y)] = min(x, y)
        node = t["node"].take(pa.array(order[starts]))
        found = np.array([find(k) for k in range(len(root))], dtype=np.int64)
        joined = np.flatnonzero(found != np.arange(len(found)))
        return pa.table({"a": node.take(pa.array(joined)), "b": node.take(pa.array(found[joined]))})

    tiles = points.select("step", "node", "_i", "_j", "latitude", "longitude", F.inline(at))
    return tiles.groupBy("step", "_ti", "_tj").applyInArrow(run, "a string, b string").distinct()


def step_groups(positions: DataFrame, cfg: ClusterConfig) -> DataFrame:
    """(step, comp, track_id): vessels of each step's components of at least min_vessels linked within distance_nm.

    positions: one (step, track_id, latitude, longitude) for each vessel and step; up to 60 degrees of latitude.  Vessels of a cell whose
    diagonal is below distance_nm are linked, so that components are those of cells: pairs of vessels are never written.
    """
    scratch = Scratch(positions.sparkSession, "clusters")
    side = cfg.distance_nm / 60.05 / 2**0.5 * 0.999  # a degree has 60.04 nm
    cells = positions.select("step", "track_id", "latitude", "longitude").where("latitude is not null and longitude is not null")
    cells = cells.withColumns({"_i": F.floor(F.col("latitude") / side), "_j": F.floor(F.col("longitude") / side)})
    points = scratch.save(cells.withColumn("node", F.concat_ws("/", "step", "_i", "_j")), "points")
    found = components(scratch.save(cell_links(points, cfg.distance_nm), "links"), scratch, "near")
    placed = points.select("step", "track_id", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node")).drop("node")
    big = placed.groupBy("component").agg(F.count("*").alias("_n"), F.min("track_id").alias("_first")).where(F.col("_n") >= max(cfg.min_vessels, 2))
    out = placed.join(big, "component").select("step", F.concat_ws("/", F.lpad(F.col("step").cast("string"), 20, "0"), "_first").alias("comp"), "track_id")
    return scratch.save(out, "members")


def blocks(members: DataFrame) -> DataFrame:
    """members with block: components that no group can join have different blocks.

    A group's components share vessels, so they hang together over each vessel's consecutive appearances; and a group ends when it
    misses two steps, so a block is cut where it has none for two steps.
    """
    scratch = Scratch(members.sparkSession, "blocks")
    before = F.lag("comp").over(W.partitionBy("track_id").orderBy("step"))
    links = members.select("comp", "track_id", "step").withColumn("_b", before).where("_b is not null")
    found = components(scratch.save(links.select(F.col("comp").alias("a"), F.col("_b").alias("b")).distinct(), "links"), scratch, "blocks")
    named = members.join(found.withColumnsRenamed({"node": "comp", "component": "_place"}), "comp", "left").withColumn("_place", F.coalesce("_place", "comp"))
    when = named.select("_place", "step").distinct()
    w = W.partitionBy("_place").orderBy("step")
    when = when.withColumn("_new", F.coalesce(F.col("step") - F.lag("step").over(w) > 2, F.lit(True)).cast("int"))
    when = when.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")
    out = named.join(when, ["_place", "step"]).withColumn("block", F.concat_ws("#", "_place", F.col("_run").cast("string")))
    return out.select("block", "step", "comp", "track_id")


def follow(steps: list[tuple[int, list[frozenset]]], overlap: float) -> list[dict]:
    """Groups over steps in order: each component, by its smallest member, goes to the group alive whose members it overlaps most.

    The oldest of equally good groups counts; a group takes in the component's members; without an overlap a new group begins; a group
    that misses two steps has ended.
    """
    alive: list[dict] = []
    ended: list[dict] = []
    for step, comps in steps:
        ended += [g for g in alive if g["last"] < step - 2]
        alive = [g for g in alive if g["last"] >= step - 2]
        taken = set()
        for comp in sorted(comps, key=min):
            scored = [(len(comp & g["members"]) / len(comp | g["members"]), -k) for k, g in enumerate(alive) if k not in taken]
            share, place = max(scored, default=(0.0, 0))
            if share >= overlap and share > 0:
                g = alive[-place]
                g["members"] |= comp
                taken.add(-place)
            else:
                g = {"first": step, "members": set(comp), "count": {}, "steps": 0, "most": 0}
                taken.add(len(alive))
                alive.append(g)
            g["last"], g["steps"], g["most"] = step, g["steps"] + 1, max(g["most"], len(comp))
            for v in comp:
                g["count"][v] = g["count"].get(v, 0) + 1
    return ended + alive


def followed(members: DataFrame, cfg: ClusterConfig) -> DataFrame:
    """(block, number, k0, k1, steps, most, core): groups with their core, the vessels present at least half of the group's steps."""

    def run(keys, t):
        by_step: dict[int, dict[str, set]] = {}
        for step, comp, v in zip(*(t[c].to_pylist() for c in ("step", "comp", "track_id")), strict=True):
            by_step.setdefault(step, {}).setdefault(comp, set()).add(v)
        groups = follow([(k, [frozenset(c) for c in by_step[k].values()]) for k in sorted(by_step)], cfg.overlap)
        rows = []
        for number, g in enumerate(sorted(groups, key=lambda g: (g["first"], min(g["members"])))):
            core = sorted(v for v, c in g["count"].items() if c >= cfg.present * g["steps"])
            rows.append({"block": keys[0].as_py(), "number": number, "k0": g["first"], "k1": g["last"], "steps": g["steps"], "most": g["most"], "core": core})
        return pa.Table.from_pylist(rows, schema=arrow)

    arrow = pa.schema([("block", pa.string()), ("number", pa.int64()), ("k0", pa.int64()), ("k1", pa.int64()), ("steps", pa.int64()), ("most", pa.int64()), ("core", pa.list_(pa.string()))])
    return blocks(members).groupBy("block").applyInArrow(run, "block string, number long, k0 long, k1 long, steps long, most long, core array<string>")


def clusters(positions: DataFrame, cfg: ClusterConfig) -> DataFrame:
    """(event, tracks, t0, t1, latitude, longitude, vessels, median_kn, severity): groups that last, are slow and large enough.

    positions also have sog.  Speeds and places are those of the core over all steps of the group.
    """
    scratch = Scratch(positions.sparkSession, "groups")
    g = followed(step_groups(positions, cfg), cfg).where((F.size("core") >= cfg.min_vessels) & ((F.col("k1") - F.col("k0") + 1) * cfg.step_s >= cfg.min_s))
    g = scratch.save(g.withColumn("event", F.concat_ws("@", "block", F.col("number").cast("string"))), "groups")
    spans = g.select("event", "k0", "k1", F.explode("core").alias("track_id"))
    at = J.range_bucket_join(positions.select("track_id", "step", "latitude", "longitude", "sog"), spans, ["track_id"], "step", "k0", "k1", 32)
    facts = at.groupBy("event").agg(F.percentile("sog", 0.5).alias("median_kn"), F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"))
    n, minutes = F.size("core"), (F.col("k1") - F.col("k0") + 1) * cfg.step_s / 60
    severity = 45 + 20 * F.least(F.lit(1.0), (n - cfg.min_vessels) / 4) + 15 * F.least(F.lit(1.0), (minutes - cfg.min_s / 60) / 120)
    out = g.join(facts, "event").where(~(F.col("median_kn") > cfg.max_kn))
    return out.select("event", F.col("core").alias("tracks"), (F.col("k0") * cfg.step_s).alias("t0"), (F.col("k1") * cfg.step_s).alias("t1"), "latitude", "longitude", n.cast("long").alias("vessels"), "steps", "most", "median_kn", severity.alias("severity"))
