"""Gatherings against a plain scan over all steps at once."""

import math
import random
import statistics

from wakeline.operators import clusters as C


def nm(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6_371_008.8 * math.asin(math.sqrt(h)) / 1852


def plain(positions, cfg):
    """Every step's components by search, then groups as records in one list."""
    steps = {}
    for k, v, la, lo, sog in positions:
        steps.setdefault(k, {})[v] = (la, lo)
    groups = []
    for k in sorted(steps):
        left, comps = set(steps[k]), []
        while left:
            todo, comp = [min(left)], set()
            while todo:
                v = todo.pop()
                if v in comp:
                    continue
                comp.add(v)
                todo += [u for u in left - comp if nm(steps[k][u], steps[k][v]) <= cfg.distance_nm]
            left -= comp
            if len(comp) >= cfg.min_vessels:
                comps.append(comp)
        used = []
        for comp in sorted(comps, key=min):
            options = [g for g in groups if g[1] >= k - 2 and g not in used and len(comp & g[2]) / len(comp | g[2]) >= 0.5]
            if options:
                g = max(options, key=lambda g: len(comp & g[2]) / len(comp | g[2]))
                g[1], g[2], g[3] = k, g[2] | comp, g[3] + [comp]
            else:
                g = [k, k, set(comp), [comp]]
                groups.append(g)
            used.append(g)
    return groups


def made(seed):
    rng = random.Random(seed)
    rows, hubs = [], [(24.0, 120.0), (24.05, 120.2), (25.0, 121.0), (24.0, 120.09)]
    home = {f"v{k:02d}": rng.randrange(4) for k in range(36)}
    for step in range(60):
        for v in home:
            if rng.random() < 0.06:
                home[v] = rng.randrange(4)
            if rng.random() < 0.75 and not (home[v] == 2 and 20 <= step < 24):
                la, lo = hubs[home[v]]
                rows.append((step, v, la + rng.gauss(0, 0.03), lo + rng.gauss(0, 0.03), rng.choice([None, 1.0, 2.0, 9.0 if home[v] == 1 else 3.0])))
    return rows


def test_groups_over_time(spark):
    cfg = C.ClusterConfig(min_s=1200)
    for seed in (1, 2):
        rows = made(seed)
        want = plain(rows, cfg)
        positions = spark.createDataFrame(rows, "step long, track_id string, latitude double, longitude double, sog double")
        got = C.followed(C.step_groups(positions, cfg), cfg).collect()
        core = lambda g: sorted(v for v in g[2] if 2 * sum(v in c for c in g[3]) >= len(g[3]))
        assert sorted((r.k0, r.k1, r.steps, r.most, r.core) for r in got) == sorted((g[0], g[1], len(g[3]), max(map(len, g[3])), core(g)) for g in want)
        assert len(want) > 10
        events = C.clusters(positions, cfg).collect()
        speed = {}
        for k, v, _, _, s in rows:
            speed.setdefault(v, {})[k] = s
        kept = []
        for g in want:
            speeds = [s for v in core(g) for k, s in speed[v].items() if g[0] <= k <= g[1] and s is not None]
            if len(core(g)) >= 4 and (g[1] - g[0] + 1) * 300 >= 1200 and not (speeds and statistics.median(speeds) > 4):
                kept.append((core(g), g[0] * 300.0, g[1] * 300.0))
        assert sorted((e.tracks, e.t0, e.t1) for e in events) == sorted(kept) and len(kept) > 3


def test_blocks_are_cut(spark):
    """Places that share no vessel, and a place that is empty for two steps, are blocks of their own."""
    cfg = C.ClusterConfig(min_vessels=2)
    rows = [(k, f"{place}{j}", 20.0 + n, 120.0, 1.0) for n, place in enumerate("abc") for j in range(3) for k in range(12) if not (place == "b" and 5 <= k < 7) and not (place == "c" and k == 5)]
    positions = spark.createDataFrame(rows, "step long, track_id string, latitude double, longitude double, sog double")
    got = C.followed(C.step_groups(positions, cfg), cfg).collect()
    assert len({r.block for r in got}) == 4
    assert sorted((r.core[0], r.k0, r.k1, r.steps) for r in got) == [("a0", 0, 11, 12), ("b0", 0, 4, 5), ("b0", 7, 11, 5), ("c0", 0, 11, 11)]


def test_no_groups(spark):
    empty = spark.createDataFrame([], "step long, track_id string, latitude double, longitude double, sog double")
    assert C.clusters(empty, C.ClusterConfig()).count() == 0
    apart = spark.createDataFrame([(k, f"v{j}", 20.0 + j, 120.0, 1.0) for k in range(5) for j in range(6)], empty.schema)
    assert C.clusters(apart, C.ClusterConfig()).count() == 0
