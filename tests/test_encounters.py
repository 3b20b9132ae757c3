"""Runs of near vessels against a plain scan over all pairs, in blocks and chunks of any size, and what is shuffled for them."""

import random

import pyarrow as pa
import pytest
from test_clusters import nm

from wakeline.operators import encounters as E
from wakeline.plans import QUERIES


def made(seed, vessels=40, steps=30):
    rng, rows = random.Random(seed), []
    for v in range(vessels):
        la, lo = rng.uniform(-0.5, 0.5), rng.uniform(119.5, 120.5)
        for k in range(steps):
            la, lo = la + rng.gauss(0, 0.05), lo + rng.gauss(0, 0.05)
            if rng.random() < 0.8:
                rows.append((k, f"v{v:03d}", la, lo))
    return rows


def plain(rows, radius):
    at, near = {}, {}
    for k, v, la, lo in rows:
        at.setdefault(k, []).append((v, la, lo))
    for k in sorted(at):
        for v, la, lo in at[k]:
            for u, la2, lo2 in at[k]:
                if v < u and nm((la, lo), (la2, lo2)) <= radius:
                    near.setdefault((v, u), []).append((k, nm((la, lo), (la2, lo2)), la))
    out = []
    for (v, u), seen in near.items():
        runs = []
        for x in seen:
            if runs and x[0] - runs[-1][-1][0] <= 2:
                runs[-1].append(x)
            else:
                runs.append([x])
        for r in runs:
            if 5 * len(r) >= 3 * (r[-1][0] - r[0][0] + 1):
                out.append((v, u, r[0][0], r[-1][0], len(r), round(sum(x[1] for x in r) / len(r), 7), round(sum(x[2] for x in r) / len(r), 7)))
    return sorted(out)


def tidy(rows):
    return sorted((r["track_id"], r["track_id2"], r["k0"], r["k1"], r["steps"], round(r["nm"], 7), round(r["latitude"], 7)) for r in rows)


def test_runs_in_small_chunks(monkeypatch):
    rows = made(1)
    t = pa.table({c: [r[i] for r in rows] for i, c in enumerate(("step", "track_id", "latitude", "longitude"))} | {"first": [r[1] < "v020" for r in rows]})
    want = plain(rows, 6.0)
    assert len(want) > 100
    for chunk in (1, 500, 10**7):
        monkeypatch.setattr(E, "CHUNK", chunk)
        assert tidy(r for b in E._runs(t, True, 6.0, False) for r in b.to_pylist()) == want
        assert tidy(r for b in E._runs(t, False, 6.0, False) for r in b.to_pylist()) == [r for r in want if r[0] < "v020" <= r[1]]


def test_blocks_and_best_of_spans(spark, monkeypatch):
    rows = made(2)
    df = spark.createDataFrame(rows, "step long, track_id string, latitude double, longitude double")
    want = plain(rows, 6.0)
    assert tidy(E.encounters(df, 6.0).collect()) == want
    monkeypatch.setattr(E, "ROWS", 150)
    assert tidy(E.encounters(df, 6.0).collect()) == want
    best = [tuple(r) for r in E.best_of_spans(df, 6.0).select("k0", "k1", "track_id", "track_id2").collect()]
    spans = {r[2:4] for r in want}
    for k0, k1 in spans:
        all_, three = sorted(r[:2] for r in want if r[2:4] == (k0, k1)), sorted(r[2:] for r in best if r[:2] == (k0, k1))
        assert len(three) <= 3
        for x in {v for p in all_ for v in p} | {""}:
            assert next((p for p in all_ if x not in p), None) == next((p for p in three if x not in p), None)


@pytest.mark.parametrize("name", ["WN15_pair_runs", "D3_meetings", "J21_dark_meetings"])
def test_pairs_are_not_shuffled(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    shuffled = [x for x in plan.splitlines() if "hashpartitioning(" in x]
    assert shuffled and not [x for x in shuffled if "track_id2#" in x or "v2#" in x]
    if name == "J21_dark_meetings":  # silences meet spans, of which few rows were written
        assert "FlatMapGroupsInArrow" not in plan and "track_id2" not in "".join(x for x in plan.splitlines() if "SortMergeJoin" in x)
