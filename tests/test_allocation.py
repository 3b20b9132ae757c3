"""Priority allocation against a plain version, and what it must conserve."""

import random

import pytest

from wakeline.operators import allocation as A

WEIGHTS = [("a", 0.4, 0.3, 0.2, 0.1), ("b", 0.0, 1.0, 0.0, 0.0), ("c", 0.1, 0.1, 0.1, 0.7)]


def world(seed):
    rng = random.Random(seed)
    ports, nodes, goods = [f"p{k}" for k in range(5)], [f"n{k}" for k in range(4)], ["x", "y", "z"]
    scenarios = ["s0", "s1"]
    cap = {(s, p): float(rng.randrange(0, 120)) for s in scenarios for p in ports}
    routes = [(s, f"{p}>{n}", p, n, float(rng.randrange(1, 9)), float(rng.randrange(1, 5)), rng.randrange(0, 10) / 10) for s in scenarios for p in ports for n in nodes if rng.random() < 0.8]
    demands = [(s, f"{n}/{g}", n, g, rng.randrange(1, 3), float(rng.randrange(1, 60))) for s in scenarios for n in nodes for g in goods]
    supplies = [(s, p, g, float(rng.randrange(5, 60))) for s in scenarios for p in ports for g in goods[:2] if rng.random() < 0.6]
    return cap, routes, demands, supplies


def plain(cap, routes, demands, supplies, scenario, w):
    room = {p: u for (s, p), u in cap.items() if s == scenario}
    begin, out = dict(room), []
    stock = {}
    for s, p, g, u in supplies:
        if s == scenario:
            stock[g] = stock.get(g, 0.0) + u
    for _, d, n, g, prio, units in sorted((x for x in demands if x[0] == scenario), key=lambda x: (x[4], -x[5], x[1])):
        mine = [r for r in routes if r[0] == scenario and r[3] == n and any(x[:3] == (scenario, r[2], g) for x in supplies)]
        need, step = units, 0

        def scale(r, i, mine=mine):
            low, high = min(x[i] for x in mine), max(x[i] for x in mine)
            return (r[i] - low) / (high - low) if high > low else 0.0

        while need > 1e-9:
            free = [r for r in mine if room[r[2]] > 1e-9]
            if not free or stock.get(g, 0) <= 1e-9:
                break
            score = lambda r: w[1] * scale(r, 4) + w[2] * scale(r, 5) + w[3] * scale(r, 6) + w[4] * (1 - room[r[2]] / begin[r[2]])  # noqa: B023, E731
            r = min(free, key=lambda r: (round(score(r), 12), r[5], r[4], r[6], r[1]))
            take, step = min(need, room[r[2]], stock[g]), step + 1
            out.append((scenario, w[0], d, step, r[1], round(take, 6), round(score(r), 6)))
            room[r[2]], stock[g], need = room[r[2]] - take, stock[g] - take, need - take
        if not step:
            out.append((scenario, w[0], d, 0, None, 0.0, 0.0))
    return out


def test_allocation(spark):
    for seed in (1, 4):
        cap, routes, demands, supplies = world(seed)
        frames = (
            spark.createDataFrame(demands, "scenario string, demand string, node string, commodity string, priority long, units double"),
            spark.createDataFrame(routes, "scenario string, route string, port string, node string, cost double, eta double, risk double"),
            spark.createDataFrame([(s, p, u, 2.0) for (s, p), u in cap.items()], "scenario string, port string, units double, handling double"),
            spark.createDataFrame(supplies, "scenario string, port string, commodity string, units double"),
            spark.createDataFrame(WEIGHTS, "weights string, w_cost double, w_eta double, w_risk double, w_load double"),
        )
        got = A.allocate(A.ledger(*frames)).collect()
        want = [x for s in ("s0", "s1") for w in WEIGHTS for x in plain(cap, routes, demands, supplies, s, w)]
        assert sorted((r.scenario, r.weights, r.demand, r.step, r.route or "", round(r.units, 6)) for r in got) == sorted((*x[:4], x[4] or "", x[5]) for x in want)
        assert any(r.step == 2 for r in got) and any(r.step == 0 for r in got)
        asked = {(x[0], x[1]): x[5] for x in demands}
        for s in ("s0", "s1"):
            for w, *_ in WEIGHTS:
                own = [r for r in got if (r.scenario, r.weights) == (s, w)]
                for p in {p for _, p in cap}:
                    assert sum(r.units for r in own if r.port == p) <= cap[s, p] + 1e-6
                for g in "xyz":
                    assert sum(r.units for r in own if r.demand.endswith(g)) <= sum(x[3] for x in supplies if x[0] == s and x[2] == g) + 1e-6
                for d in {r.demand for r in own}:
                    assert sum(r.units for r in own if r.demand == d) + next(r.unmet for r in own if r.demand == d) == pytest.approx(asked[s, d])
    assert A.allocate(A.ledger(*[f.limit(0) for f in frames[:4]], frames[4])).count() == 0
