"""Operators on embeddings against plain versions."""

import math

import numpy as np
import pytest

import __spark_entry__ as entry

NAN, INF = float("nan"), float("inf")


def table(spark, rows, extra=False):
    """rows of (vec_id, embedding, label); extra: with columns whose names operators use themselves."""
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.selectExpr("*", "1 as n", "'x' as score", "2 as rank", "3 as cell", "4 as x", "5 as component") if extra else df


def made(n, d=8, seed=0, copies=0):
    """Rows in a few directions, of which the last `copies` are the same vector."""
    r = np.random.default_rng(seed)
    centres = r.standard_normal((5, d))
    v = (centres[r.integers(0, 5, n)] + 0.7 * r.standard_normal((n, d))).astype(np.float32)
    if copies:
        v[-copies:] = v[-1]
    return [(i, [float(c) for c in x], int(r.integers(0, 10))) for i, x in enumerate(v)]


ODD = [(900, None, 1), (901, [], 1), (902, [NAN] * 8, 2), (903, [INF] + [0.0] * 7, 3), (904, [None] + [0.1] * 7, 3), (905, [0.0] * 8, 4), (906, [1.0, 2.0], 4), (None, [0.5] * 8, 5), (907, [0.25] * 8, None)]


# --- whitening


def plain_whitening(rows, d):
    kept = [(i, np.array(v, float)) for i, v, *_ in rows if v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([np.floor(64 * v).astype(int) + 1_000_000 for _, v in kept])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return [i for i, _ in kept], n, [int(sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True))) for r in x], (x - s / n) @ vectors / np.sqrt(values), values


@pytest.mark.parametrize("d", [8, 40])
def test_whitening(spark, d):
    from wakeline.llm.whitening import whiten

    rows = made(300, d, copies=100)
    rows = rows + [rows[5]] + (ODD if d == 8 else [])
    got = {(r.vec_id, r.component): r for r in whiten(table(spark, rows, extra=True)).collect()}
    ids, n, dev, z, values = plain_whitening(rows, d)
    k = min(16, d)
    assert set(got) == {(i, c + 1) for i in ids for c in range(k)}
    sign = {c: np.sign(got[ids[0], c + 1].whitened * z[0, c]) for c in range(k)}
    for j, i in enumerate(ids):
        for c in range(k):
            r = got[i, c + 1]
            assert (r.n, r.deviation) == (n, dev[j])
            assert r.whitened == pytest.approx(sign[c] * z[j, c], rel=1e-7, abs=1e-7)
            assert r.explained == pytest.approx(values[c] / values.sum(), rel=1e-9)
            assert r.identity_error < 1e-9


def test_whitening_small(spark):
    from wakeline.llm.whitening import whiten

    assert whiten(table(spark, [])).count() == 0
    assert whiten(table(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).count() == 0
    two = whiten(table(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 3.0], 0), (2, [1.0, 3.0], 0)])).collect()
    assert [(r.n, r.component) for r in two] == [(2, 1)] * 3 and all(abs(r.whitened) == pytest.approx(1) for r in two)
    far = whiten(table(spark, [(1, [1e15, 0.0], 0), (2, [0.0, 1e15], 0), (3, [1e30, 1.0], 0)])).collect()
    assert {r.vec_id for r in far} == {1, 2} and all(r.deviation is None for r in far)


def test_jacobi_davidson_without_spanning_all():
    """A space far smaller than all dimensions, with eigenvalues that are close and equal."""
    from wakeline.llm.whitening import leading

    r = np.random.default_rng(3)
    q = np.linalg.qr(r.standard_normal((400, 400)))[0]
    values = np.concatenate([[5.0, 5.0, 4.9999, 4.0], np.linspace(3.5, 0, 396) ** 2 / 4])
    m = (q * values) @ q.T
    passes = []

    def product(x):
        passes.append(x.shape[1])
        return m @ x

    got, vectors = leading(product, 400, 12)
    assert got == pytest.approx(sorted(values)[::-1][:12], rel=1e-12)
    assert np.abs(m @ vectors - vectors * got).max() < 1e-12
    assert np.abs(vectors.T @ vectors - np.eye(12)).max() < 1e-12
    assert max(passes) <= 24


# --- hard negatives


def plain_negatives(rows, every, scale=256):
    kept = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and len(v) == 8 and all(c is not None and math.isfinite(c) for c in v):
            kept.setdefault(i, (label, [math.floor(scale * np.float32(c).astype(float)) for c in v]))
    out = set()
    for a, (own, x) in kept.items():
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), i, label) for i, (label, y) in kept.items() if i != a)
        for score, pos, _ in [s for s in scored if s[2] == own][:5]:
            near = [s for s in scored if s[2] != own and 50 * -score <= 100 * -s[0] <= 95 * -score][:3]
            out |= {(a, pos, k + 1, n, -score, -s) for k, (s, n, _) in enumerate(near)}
    return out


@pytest.mark.parametrize("scale,copies", [(256, 0), (256, 150), (2, 40), (2**24, 0)])
def test_hard_negatives(spark, monkeypatch, scale, copies):
    from wakeline.llm import hard_negatives

    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    monkeypatch.setattr(hard_negatives, "CHUNK_BYTES", 8 * 8 * 16 * 2)  # two trees a chunk
    rows = made(400, copies=copies, seed=copies) + ODD
    rows.append(rows[10])
    got = hard_negatives.mine(table(spark, rows, extra=True), every=5, scale=scale)
    assert {tuple(r) for r in got.collect()} == plain_negatives(rows, 5, scale)
    assert got.count() == len(set(got.collect()))


def test_hard_negatives_small(spark):
    from wakeline.llm.hard_negatives import mine

    assert mine(table(spark, [])).count() == 0
    assert mine(table(spark, ODD[:5])).count() == 0
    assert mine(table(spark, [(50, [1.0, 0.0], 1), (51, [1.0, 0.0], 1)])).count() == 0
    # the negative's score is exactly 95 % of the positive's, then just above
    edge = [(0, [100 / 256, 0.0], 1), (1, [100 / 256, 0.0], 1), (2, [95 / 256, 0.0], 2), (3, [96 / 256, 0.0], 2), (4, [50 / 256, 0.0], 2), (5, [49 / 256, 0.0], 2)]
    assert [tuple(r) for r in mine(table(spark, edge)).orderBy("rank").collect()] == [(0, 1, 1, 2, 10000, 9500), (0, 1, 2, 4, 10000, 5000)]


def test_tree_bounds_save_scores():
    """On tight clusters most rows are never scored, and what is found is what scoring all finds."""
    import pyarrow as pa

    from wakeline.llm.hard_negatives import Anchors, spanning_tree
    from wakeline.llm.vectors import lists

    r = np.random.default_rng(1)
    centres = r.integers(-200, 200, (12, 16)).astype(float)
    x = centres[r.integers(0, 12, 3000)] + r.integers(-3, 4, (3000, 16))
    a = x[:200]
    order, parent, edge = spanning_tree(a)
    assert sorted(order) == list(range(200)) and (parent[1:] < np.arange(1, 200)).all()
    assert np.allclose(edge[1:], np.linalg.norm(a[order[1:]] - a[order[parent[1:]]], axis=1))
    t = pa.table({"vec_id": order, "label": np.zeros(200, int), "x": lists(a[order]), "block": np.zeros(200, int), "place": np.arange(200), "parent": parent, "edge": edge})
    anchors, found = Anchors(t, 16, True), set()
    least = 0.8 * np.linalg.norm(a, axis=1).max() ** 2
    anchors.walk(x, np.linalg.norm(x, axis=1), lambda k: np.ones(3000, bool), lambda k: (least, np.inf), lambda k, at, s: found.update((int(anchors.id[k]), int(j)) for j, v in zip(at, s, strict=True) if v >= least))
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(a @ x.T >= least), strict=True)}
    assert found == want and anchors.rescored < 0.3 * 200 * 3000


# --- nearest neighbours


def plain_nearest(rows, every, k, d=8):
    kept = {}
    for i, v, _ in rows:
        if i is not None and v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v) and any(v):
            kept.setdefault(i, np.array(v, np.float32).astype(float))
    ids = np.array(sorted(kept))
    x = np.array([kept[i] for i in ids])
    out = {}
    for q in ids[ids % every == 0]:
        s = (x * kept[q]).sum(axis=1)
        out[int(q)] = [(int(ids[j]), float(s[j])) for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
    return out


def by_query(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("copies", [0, 700])
def test_nearest(spark, monkeypatch, copies):
    """A forest of many leaves; small pieces and blocks; a leaf of copies."""
    from wakeline.llm import projection_forest as forest

    for name, value in (("PIECE", 64), ("QUERY_BLOCK", 16), ("SLICE", 32), ("KEPT", 50)):
        monkeypatch.setattr(forest, name, value)
    rows = made(2000, copies=copies, seed=7) + ODD
    rows.append(rows[20])
    want = plain_nearest(rows, 20, 20)
    got = by_query(forest.nearest(table(spark, rows, extra=True), leaf_rows=50, sample=1500, sample_queries=40))
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    vectors = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows[:2000]}
    for q, found in got.items():
        assert len(found) == 20 and found == sorted(found, key=lambda r: (-r[1], r[0])) and len({i for i, _ in found} | {q}) == 21
        assert all(s == pytest.approx(float((vectors[i] * vectors[q]).sum()), rel=1e-12) for i, s in found if i in vectors)


def test_nearest_exact_where_all_is_searched(spark):
    from wakeline.llm.projection_forest import nearest

    rows = made(300, copies=60, seed=2)
    got, want = by_query(nearest(table(spark, rows))), plain_nearest(rows, 20, 20)
    assert {q: [i for i, _ in r] for q, r in got.items()} == {q: [i for i, _ in r] for q, r in want.items()}
    few = by_query(nearest(table(spark, rows[:7])))
    assert {q: len(r) for q, r in few.items()} == {0: 6}
    assert nearest(table(spark, [])).count() == 0 and nearest(table(spark, ODD[:6])).count() == 0
    assert nearest(table(spark, rows[:1])).count() == 0


def test_nearest_recall(spark):
    """The registered query on the given table."""
    sf_dir = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = plain_nearest(rows, 20, 20, 64)
    got = by_query(entry.queries()["op11_nearest_neighbours"](spark, sf_dir))
    assert set(got) == set(want)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)


def test_forest_queue_opens_best_leaf_first():
    from wakeline.llm.projection_forest import grow

    r = np.random.default_rng(5)
    x = r.standard_normal((600, 6))
    forest = grow(x, 3, 20)
    leaves = forest.route(x)
    assert leaves.shape == (600, 3) and len(np.unique(leaves)) == forest.leaves
    sizes = np.bincount(leaves.ravel(), minlength=forest.leaves)
    order = list(forest.visit(forest.margins(x[:1])[0], sizes, np.inf))
    assert set(order[k][0] for k in range(3)) == set(leaves[0]) and len(order) == forest.leaves
    assert [t for _, t in order] == [0, *np.cumsum(sizes[[c for c, _ in order]])[:-1]]
    assert len(list(forest.visit(forest.margins(x[:1])[0], sizes, 25))) < 5
    same = grow(np.ones((50, 6)), 3, 20)
    assert same.leaves == 1 and same.route(x).shape == (600, 1)
