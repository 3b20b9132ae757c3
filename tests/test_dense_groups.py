"""Components of near vessels: the same as from all pairs, and without writing pairs where many vessels lie close together."""

import random

from test_clusters import nm

from wakeline.operators import clusters as C
from wakeline.scratch import Scratch


def brute(places, limit):
    """Smallest member of each place's component, by search."""
    left, out = set(range(len(places))), {}
    while left:
        first = min(left)
        todo, comp = [first], {first}
        while todo:
            v = todo.pop()
            new = {u for u in left - comp if nm(places[u], places[v]) <= limit}
            comp |= new
            todo += new
        left -= comp
        out |= {v: (first, len(comp)) for v in comp}
    return out


def test_dense_and_sparse_components(spark, monkeypatch):
    cfg = C.ClusterConfig(distance_nm=3.0, min_vessels=3)
    rng = random.Random(4)
    steps = {
        0: [(rng.uniform(59, 60), rng.uniform(-1, 2)) for _ in range(300)],  # about where components begin to hang together, over tiles
        1: [(rng.uniform(-0.6, 0.6), rng.uniform(-0.6, 0.6)) for _ in range(250)],
        2: [(24 + rng.uniform(0, 0.2), 120 + rng.uniform(0, 0.2) + 0.2543 * (k % 2)) for k in range(400)],  # two crowds about a distance apart
    }
    rows = [(s, f"v{k:05d}", la, lo) for s, places in steps.items() for k, (la, lo) in enumerate(places)]
    crowd = [(3, f"v{k:05d}", 24 + rng.uniform(0, 0.1), 120 + rng.uniform(0, 0.1)) for k in range(1500)]
    written, save = [], Scratch.save

    def counted(self, df, name):
        out = save(self, df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "save", counted)
    found = C.step_groups(spark.createDataFrame(rows + crowd, "step long, track_id string, latitude double, longitude double"), cfg).collect()
    got = {}
    for r in found:
        got.setdefault((r.step, r.comp), set()).add(r.track_id)
    want = [{f"v{k:05d}" for k, (f, n) in brute(places, 3.0).items() if f == first} for s, places in steps.items() for first, n in set(brute(places, 3.0).values()) if n >= 3]
    want.append({r[1] for r in crowd})
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))
    assert max(written) <= len(rows) + len(crowd)  # pairs of the crowd alone would be over a million
